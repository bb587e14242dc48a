"""Long labelled documents are learned from as a whole."""

from lumenlake.llm import toxicity


def test_no_term_of_a_long_text_is_cut(spark):
    bits = toxicity.Settings().bits
    word = lambda i: "w" + "".join(chr(97 + int(d)) for d in f"{i:05d}")
    common = " ".join(map(word, range(5000)))
    low = sorted(toxicity.hashes_of(common, bits, {}))
    assert len(low) > 4096
    sign = next(x for i in range(90000, 99999) if toxicity.hashes_of(x := word(i), bits, {})[0] > low[4096] and min(toxicity.hashes_of(x, bits, {})) > 0)
    rows = [(i, f"{common} {sign if i % 2 else ''}", i % 2) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    out = {r.doc_id: r.predicted for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert len(model.terms) > 0 and all(out[i] == i % 2 for i in out)
