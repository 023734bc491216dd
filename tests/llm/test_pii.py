import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from glyphstream.llm.pii import base_spans, find, luhn, made_up, redact, all_spans, trained, zones


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@@%+-+ 0123459..()é٣\n", max_size=60) | st.from_regex(r"(a\.b@c-d\.e(\.|@|\+1 )?|[0-9]{1,4}\.[0-9]{1,3}|\+49 \([0-9]{3}\)| ){1,8}", fullmatch=True))
def test_base_spans_as_plain_patterns(text):
    assert base_spans(text) == plain(text)


def test_cards():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert base_spans("x 4111 1111-11111111 y") == [("card", 2, 20)]
    assert base_spans("4111 1111 1111 1111 1") == plain("4111 1111 1111 1111 1")


def test_model_finds_other_writings_and_leaves_other_numbers():
    rng, right, wrong, entities = random.Random(5), 0, 0, 0
    for _ in range(300):
        text, gold = made_up(rng)
        base, added = all_spans(text, trained())
        entities += len(gold)
        right += sum(g in base + added for g in gold)
        wrong += len(set(base + added) - set(gold)) - 0
    assert right > 0.9 * entities and wrong < 0.1 * entities
    base, added = all_spans("The house of 1996 has 12 rooms and 3.5 baths, see 2001-10-12 at noon.", trained())
    assert base == added == []


def test_tables(spark):
    rows = [(1, "a@b.co É 10.0.0.1, call (555) 123-4567"), (2, None), (3, ""), (None, "+49 30 1234567"), (1, "1" * 200000), (4, "a" * 100000 + "@")]
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, spans string")
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base], [(s.kind, s.start) for s in r.spans if not s.base]) for r in find(docs).collect()]
    assert got[0] == (1, [("email", 0, 6), ("ip", 9, 17)], [("phone", 24)])
    assert [g[1] for g in got[1:]] == [[], [], [("phone", 0, 14)], [], []]
    clean = redact(docs).collect()
    assert clean[0].text == "[email] É [ip], call [phone]" and clean[1].text is None and clean[0].spans == "s"
    assert find(docs.limit(0)).count() == 0


def test_gates_let_through_what_the_model_knows():
    long = "n" * 120
    for entity in ("8 . 8 . 8 . 8", "10 . 0 . 0 . 1", "jane (AT) host (DOT) com", "jane AT host DOT com", f"{long} (at) host (dot) com", "jane (at) a.b.c.d.e.com"):
        text = f"write to {entity}, please"
        assert [text[a:b] for a, b in zones(text)] == [entity], entity
    for kind, entity in (("ip", "10 . 0 . 0 . 1"), ("email", "jane (AT) host (DOT) com"), ("email", f"{long} (at) host (dot) com")):
        text = f"write to {entity}, please"
        assert (kind, 9, 9 + len(entity)) in all_spans(text, trained())[1], entity


def test_long_runs_of_numbers_take_linear_time():
    import time

    model = trained()
    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        all_spans("1 " * n, model)
        all_spans("+49 30 1234567, " * (n // 8), model)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1


def test_query_as_plain_patterns(spark):
    import hashlib

    from glyphstream.llm.pii import KINDS, query

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = query(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in KINDS]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r.spans.split(","))
