import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docket.llm import disclosure

from .helpers import documents, odd_rows, prose

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            fits = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),  # noqa: B023
                "card": lambda: 13 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0,  # noqa: B023
                "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@@..-_%+ 0123456789()é٣\n", max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert disclosure.base_spans(text) == brute(text)


def test_long_runs_are_quick():
    text = "a" * 300_000 + " " + "1" * 300_000 + "+" * 1000 + "x@" * 50_000
    assert disclosure.base_spans(text) == []


def test_terms_that_disclose(spark):
    """`quixolt` stands nowhere but beside one address, in four different texts; `common` stands everywhere."""
    rows = [(i, f"common {prose(i, 30)} quixolt Ann@x.org {prose(40 + i, 30)} common") for i in range(4)]
    rows += [(10 + i, f"common {prose(80 + i, 40)} common") for i in range(30)]
    rows += [(50 + i, "same words zyxwort bob@y.org again") for i in range(5)]  # copies are one surrounding
    rows += [(60, "quixolt alone"), (61, "call +1 (555) 555-0123 now"), *odd_rows()]
    docs = documents(spark, rows)
    terms = {r.term: r for r in disclosure.disclosing_terms(docs).collect()}
    assert "quixolt" in terms and "common" not in terms and "zyxwort" not in terms
    assert terms["quixolt"].entity == "email:ann@x.org" and 0.8 < terms["quixolt"].disclosed <= 1
    found = disclosure.personal_data(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [(s.kind, s.start, s.end) for s in r.base] == brute(r.text)
        assert sum(r.text[s.start : s.end].lower() == "quixolt" for s in r.added) == r.text.count("quixolt")
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert clean[60] == " alone" and clean[61] == "call [phone] now" and "[email]" in clean[0] and "quixolt" not in clean[0]


def test_two_surroundings_suffice_for_a_term_seen_nowhere_else(spark):
    """`vexholm` stands beside one address in two texts, `murble` beside it in one, `plain` in those two and elsewhere."""
    rows = [(i, f"{prose(i, 20)} vexholm plain {'murble' if i else ''} eve@z.org {prose(30 + i, 20)}") for i in range(2)]
    rows += [(10 + i, f"plain {prose(80 + i, 40)}") for i in range(60)]
    docs = documents(spark, rows)
    terms = {r.term: r.disclosed for r in disclosure.disclosing_terms(docs).collect()}
    assert 0.5 <= terms["vexholm"] < 0.8 and "murble" not in terms and "plain" not in terms
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert "[term]" in clean[0] and "vexholm" not in clean[1] and "murble" in clean[1]


def test_empty_table(spark):
    assert disclosure.personal_data(documents(spark, [])).collect() == []
