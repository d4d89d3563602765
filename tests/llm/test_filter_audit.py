import random
import re
from itertools import permutations

from tests.llm.helpers import empty_frame, odd_documents, odd_frame, prose
from wardline.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, part string, version long"
SCHEMA = "doc_id long, text string, source string, part string, version string, set int, runs int, digest string, good int"


def documents():
    """Rows that fail every mix of filters, copies by the dozen, ids with several texts, and a part that holds most rows."""
    rng = random.Random(4)
    base = [
        "river " * 60, prose(rng, 90), "ABC DEF " * 40, "short", "", None, "a $ sign", " \x0b\x1f\x1c ", "É" * 20 + "A", "A" + "é" * 19,
        "AB" + "é" * 38, " ".join(f"w{n}" for n in range(50)), " ".join(f"w{n}" for n in range(49)), "x|y " * 55, "AAAA # " * 70,
    ]
    rows = [(n, base[n % len(base)] if n % 2 else rng.choice(base), ["hot", "hot", "hot", "b", None, ""][n % 6]) for n in range(150)]
    rows += [(r[0], r[1], r[3]) for r in odd_documents()] + [(7, "another text of id 7", "b"), (7, "another text of id 7", "b"), (9, rows[9][1], "b")]
    rows += [(8000, "AB c", "b"), (-3, "D # d", "hot"), (8001, "ABC DEF GHI " * 30, "")]
    return rows


def labels():
    return [(n, n % 3 % 2, n % 5 % 2, "clash", 1) for n in range(0, 160, 2)] + [(4, 1, None, None, None), (4, 0, 1, None, None), (None, 1, 1, None, None), (6, None, None, None, 3)]


def failing_letters(rows):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        out.append({
            f for f, fails in (
                ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)),
                ("D", bool(re.search(r"[#$%&*|]", t))), ("E", i is not None and i > smallest[t])) if fails})
    return out


def plain(rows, marks):
    kept_rows = [(r, f) for r, f in zip(rows, failing_letters(rows), strict=True) if r[0] is not None]
    good = {m[0] for m in marks if m[1] == 1}
    toxic = {m[0] for m in marks if m[2] == 1}
    out = {}
    for part in {r[2] or "" for r, _ in kept_rows}:
        mine = [(r[0], f) for r, f in kept_rows if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                removed = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                failed = sum(letter in f for _, f in mine)
                total[letter] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), failed - len(removed), sum(f == {letter} for _, f in mine),
                    sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), letter]
        for (p, _, _), line in out.items():
            if p == part:
                line[-1] = total.get(line[-1], line[-1])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1, 1, "clash", 1) for r in rows], SCHEMA).repartition(3)


def test_every_order_against_plain_counts(spark):
    rows, marks = documents(), labels()
    assert {frozenset(f) for f in failing_letters(rows)} >= {frozenset(x) for x in ("", "A", "AC", "AE", "BC", "BCDE", "ACD")}
    got = filter_audit.filter_interactions(frame(spark, rows), spark.createDataFrame(labels(), LABELS)).collect()
    want = plain(rows, marks)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows if r[0] is not None})
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]


def test_one_order_step_by_step(spark):
    """The joins of a single order agree with the sets' counts."""
    rows, failing = filter_audit.failing_ids(frame(spark, documents()))
    want = plain(documents(), [])
    for order in ("DBEAC", "ECABD"):
        for r in filter_audit.audit_order(rows, failing, order).collect():
            line = want[r.part, order, r.step]
            assert r["filter"] == order[r.step - 1] and [r.kept, r.removed, r.redundant] == line[:3]


def test_tables_hold_one_id_each(spark):
    _, failing = filter_audit.failing_ids(frame(spark, documents()))
    for letter, ids in failing.items():
        found = ids.collect()
        assert len(found) == len(set(found)) and found, letter


def test_odd_and_empty_tables(spark):
    marks = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_interactions(empty_frame(spark), marks).collect() == []
    got = filter_audit.filter_interactions(odd_frame(spark), marks).collect()
    odd = [(r[0], r[1], r[3]) for r in odd_documents()]
    want = plain(odd, [])
    assert {(r.part, r.filter_order, r.step): r.kept for r in got} == {k: v[0] for k, v in want.items()}


def test_no_document_fails(spark):
    text = " ".join(f"word{n}" for n in range(60))
    got = filter_audit.filter_interactions(
        spark.createDataFrame([(1, text, "s"), (2, text + " more", "s")], "doc_id long, text string, source string"),
        spark.createDataFrame([], LABELS)).collect()
    assert {(r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got} == {(2, 0, 0, 0, 0)} and len(got) == 600
