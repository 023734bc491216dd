import corpus_pipeline
from glyphstream.llm import quality
from glyphstream.llm._scratch import table

SF = "/root/testdata/sf0.001"


def test_stages_as_plain_python(spark):
    from collections import defaultdict

    from test_exact_dedup import low
    from test_jaccard_join import brute
    from test_scans import contaminated
    from tokenizers import Tokenizer

    from glyphstream.llm.packing import tokenizer_file

    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in quality.keep_good(docs, table(spark, SF, "labels")).collect()}
    last = {}
    for key in sorted(texts):
        last[low(texts[key])] = key
    texts = {k: texts[k] for k in last.values()}
    kept = {least for _, _, least in brute(sorted(texts.items()))}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    texts = {k: texts[k] for k in kept if not contaminated(texts[k], items, 10)[1]}
    tok = Tokenizer.from_file(tokenizer_file())
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r.doc_id] += r.length
        assert r.doc_tokens == len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1
    assert set(pieces) == set(texts)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_of_five_words_at_four_fifths(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:25], "other", *words[26:]])), (3, " ".join([*words[:15], "x", *words[16:35], "y", *words[36:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # 2: 41 of 51 shingles of five words (0.804), 43 of 51 of four (0.843); 3 is beyond both.
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == {1, 3}
