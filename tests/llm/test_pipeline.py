"""The pipeline's stages against brute force on a small table."""

import random

import public_tokenizers
from tokenizers import Tokenizer as Library

import corpus_pipeline
from test_operators import brute_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    r = random.Random(8)
    en = "the of and to in that was for with this from have not are but they which".split()
    de = "der die und das nicht mit ein ist von auch sich werden für können".split()
    rows = []
    for k in range(150):
        words = r.choices(en if k % 3 else de, k=60)
        rows.append((k, " ".join(words), "en" if k % 3 else "de", f"s{k % 4}", 0))
    near = rows[1][1].split()
    for k in range(150, 156):
        copy = list(near)
        copy[r.randrange(60)] = f"x{k}a"
        rows.append((k, " ".join(copy), "en", "s1", 0))
    rows += [(160, rows[2][1].upper(), "en", "s2", 0), (161, "12 34 !!", "en", "s0", 0), (162, None, "en", None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {i: t for i, t, *_ in rows}
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append(sorted(x["doc_id"] for x in docs.collect()))
    clean = [i for i in text if i < 161]
    assert out[0] == clean
    by_text = {}
    for i in clean:
        by_text.setdefault(text[i].lower(), []).append(i)
    assert out[1] == sorted(max(ids) for ids in by_text.values())
    comp = brute_components([(i, text[i]) for i in out[1]], 5, 4, 5)
    assert out[2] == [i for i in out[1] if comp[i][1] == i]
    assert set(out[3]) <= set(out[2]) and len(out[3]) > len(out[2])
    assert out[4] == out[3]
    library = Library.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for x in docs.collect():
        assert x["n_tokens"] == len(library.encode(text[x["doc_id"]], add_special_tokens=False).ids)


def test_run_on_odd_tables(spark, tmp_path):
    """No rows; null ids, repeated rows, ties and a very long text."""
    empty = spark.createDataFrame([], DOCS)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    r = random.Random(2)
    words = "the of and to in that was for with this from have not are but they which".split()
    rows = [(k, " ".join(r.choices(words, k=80)), "en", "a", 0) for k in range(40)]
    rows += [rows[3], rows[3], (None, " ".join(r.choices(words, k=80)), "en", None, 0), (90, " ".join(r.choices(words, k=40_000)), "en", "b", None), (91, "", None, "b", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = [x["doc_id"] for x in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()]
    assert set(got) <= {*range(40), None, 90} and got.count(3) <= 2 and len(got) >= 40
