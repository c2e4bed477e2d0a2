import random
import re

import pytest

from reelhouse.llm import pii
from tests.llm.helpers import ODD, documents

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def counts(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in text.split(".")),
            "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text or "") if counts(k, m[0])]


def test_base_spans_match_brute_force(spark):
    r = random.Random(8)
    parts = ["a", "@", "b.c", "_", ".", "1", "2", "255", "256", "300", "+", "(", ")", " ", "-", "4111 1111 1111 1111",
             "4111111111111111", "5500-0000-0000-0004", "é", "日", "\n", "0", "00", "1.2.3.4", "x@y.z", "+1 (415) 555-2671", "𝒳", "%"]
    texts = ["".join(r.choice(parts) for _ in range(r.choice([1, 5, 20, 60]))) for _ in range(400)] + ODD
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, "x@y.z", None)])
    got = pii.find_personal_data(df).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        want = base(texts[row.doc_id] if row.doc_id is not None else "x@y.z")
        assert [tuple(s) for s in row.base] == want
        assert set(want) <= {tuple(s) for s in row.spans}
        order = [(pii.KINDS.index(s.kind), s.start) for s in row.spans]
        assert order == sorted(order)


def test_short_runs_of_digits_match_brute_force(spark):
    # numbers written in pairs, in texts without three digits in a row
    r = random.Random(21)
    parts = ["+", "+33 6 12 34 56 78", "1", "22", " ", "-", ".", "(", ")", ":", "a", "@b.c", "4 1 1 1-1 1 1 1 1 1 1 1 1 1 1 1"]
    texts = ["+33 6 12 34 56 78", "tel +49-30-12-34-56.", "1.2.3.4", "x@y.z"]
    texts += ["".join(r.choice(parts) for _ in range(r.choice([1, 3, 12]))) for _ in range(300)]
    got = {row.doc_id: row for row in pii.find_personal_data(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == base(t), t
    assert [tuple(s) for s in got[0].base] == [("phone", 0, 17)]


@pytest.mark.parametrize("text", ["a" * 200000, "1" * 200000, "+1" * 50000, "a@" * 50000, "1 " * 100000])
def test_long_runs_take_linear_time(spark, text):
    # a quadratic match of these would take many minutes
    assert pii.candidates(documents(spark, [(1, text, "s")])).count() == 1


def test_labelers_find_further_spans_and_leave_clean_texts(spark):
    rows = [(i, f"please call ({200 + i}) 555-{1000 + i} today, tel: 212-555-{2000 + i}, or mail jan{i}(at)host{i % 5}(dot)com "
                f"or ann{i}@corp.com", "s") for i in range(120)]
    rows += [(1000 + i, f"call +1 (415) 555-{1000 + i}; version 1.2.{i}.4", "s") for i in range(80)]
    clean = [(2000 + i, f"the order 12{i} of chapter 4 costs 100-200 and {i}.5 percent", "s") for i in range(50)]
    got = {r.doc_id: r for r in pii.find_personal_data(documents(spark, rows + clean)).collect()}
    more = sum(len(got[i].spans) - len(got[i].base) for i, _, _ in rows[:120])
    assert more >= 200
    assert all(got[i].spans == [] for i, _, _ in clean)


def test_main_path_has_no_python(spark):
    df = documents(spark, [(1, "x@y.z", "s")])
    plan = pii.find_personal_data(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table_and_table_without_spans(spark):
    assert pii.find_personal_data(documents(spark, [])).collect() == []
    got = pii.find_personal_data(documents(spark, [(1, "nothing here", "s")])).collect()
    assert [(r.base, r.spans) for r in got] == [([], [])]
