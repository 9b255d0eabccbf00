"""Personal data against a plain reading of the patterns, planted cases, long texts and odd rows."""

import random
import re
import time

import pytest

from farsight.llm import pii
from farsight.llm.registry import ORACLES, QUERIES
from workload.compare import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"
NAMES = [k.name for k in pii.KINDS]


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def digits(match):
    return re.sub("[^0-9]", "", match)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
}


def plain(text):
    """Base spans by Python's own pattern matching."""
    return sorted(
        (m.start(), NAMES.index(kind) + 1, m.end())
        for kind, (pattern, good) in BASE.items() for m in re.finditer(pattern, text or "") if good(m.group()))


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_personal(docs).collect()}


def test_base_spans_equal_the_plain_patterns(llm):
    rng = random.Random(11)
    parts = ["a@b.c", "a.b+c@d-e.f.g", "@", ".", "-", " ", "_", "%", "1.2.3.4", "999.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004",
             "+1 (743) 555-3824", "+49", "+", "(", ")", "12", "7", "é🙂", "日", "\n", "xx", "٣", "ſ", "555-3824", "6011000990139424", "123456789012345678901234"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    out = found(llm, texts)
    for k, text in enumerate(texts):
        assert [s[:3] for s in out[k] if s[1] <= 4] == plain(text), text


def test_checksums_and_context_decide_added_kinds(llm):
    texts = [
        "My account is GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 33", "DE89370400440532013000", "XDE89370400440532013000",
        "her SSN 123-45-6789", "part 123-45-6789", "SSN 000-45-6789", "ssn: order 123-45-6789", "call (212) 555-0147 now", "call +1 (212) 555-0147 now", "id 212-555-0147",
    ]
    out = found(llm, texts)
    kinds = [[NAMES[s[1] - 1] for s in out[k]] for k in range(len(texts))]
    assert kinds == [["iban"], [], ["iban"], [], ["national_id"], [], [], [], ["local_phone"], ["phone"], []]
    assert texts[0][out[0][0][0]:out[0][0][2]] == "GB82 WEST 1234 5698 7654 32"
    assert out[0][0][3] == 1.0 and out[2][0][3] == 0.9


def test_context_moves_the_score_of_base_spans_but_keeps_them(llm):
    texts = ["login from 10.0.0.1", "seen 10.0.0.1", "version 10.0.0.1", "Version 10.0.0.1 of host"]
    assert [v[0][3] for _, v in sorted(found(llm, texts).items())] == [0.9, 0.5, 0.2, 0.6]


def test_added_spans_give_way_to_base_spans_that_they_overlap(llm):
    text = "call 212-555-0147@mail.com or tel 212-555-0147 or phone +1 212-555-0147"
    spans = found(llm, [text])[0]
    assert [(NAMES[k - 1], text[a:b]) for a, k, b, _ in spans] == [("email", "212-555-0147@mail.com"), ("local_phone", "212-555-0147"), ("phone", "+1 212-555-0147")]


@pytest.mark.parametrize("text, kind, n", [
    (" ".join(f"a{i}@b{i}.com" for i in range(64_000)), "email", 64_000), ("x" * 2_000_000, "email", 0), ("1 " * 500_000, "card", 0),
    ("a." * 400_000 + "@" + "a." * 400_000 + "b", "email", 1), ("+1 (((" * 50_000, "phone", 0), ("1." * 400_000, "ip", 100_000), ("ssn 123-45-6789 " * 60_000, "national_id", 60_000),
])
def test_long_texts_are_read_whole_in_linear_time(llm, text, kind, n):
    began = time.time()
    spans = found(llm, [text])[0]
    assert time.time() - began < 60
    assert [NAMES[s[1] - 1] for s in spans] == [kind] * n
    assert all(text[a - 1:a] in ("", " ", ".") and text[b:b + 1] in ("", " ", ".") for a, _, b, _ in spans)


def test_odd_and_clashing_rows(odd, none):
    out = pii.find_personal(odd)
    assert sorted(out.columns) == sorted(odd.columns) and out.count() == odd.count()
    assert out.where("size(spans) > 0").count() == 0 and pii.find_personal(none).count() == 0
    clash = odd.selectExpr("doc_id", "'a@b.c' as text", "1 as row", "2 as m_email", "3 as p_email", "4 as email", "n_words")
    assert {(r.row, r.m_email, r.p_email, r.email, len(r.spans)) for r in pii.find_personal(clash).collect()} == {(1, 2, 3, 4, 1)}


def test_runs_no_python(llm):
    plan = QUERIES["op11_personal_data"](llm, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_query_equals_its_sql(llm):
    assert rows_of_spark(QUERIES["op11_personal_data"](llm, SF)) == rows_of_sql(connect(SF), ORACLES["op11_personal_data"])
