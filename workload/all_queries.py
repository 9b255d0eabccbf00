"""Imports every query module, which registers its queries."""

from workload import hits  # noqa: F401
from workload import requests, verdicts  # noqa: F401
from workload import labels, store  # noqa: F401
from workload import history, inputs  # noqa: F401
from workload import pages  # noqa: F401
