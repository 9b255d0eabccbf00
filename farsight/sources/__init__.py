"""Tables in and out: requests, pages, citations, vocabularies, stores, snapshots."""
