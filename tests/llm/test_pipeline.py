"""The whole pipeline against plain versions of its stages on a small table."""

import random

import duckdb
import public_tokenizers
import sentencepiece

import corpus_pipeline as P
from quillon.llm import langid
from quillon.llm.line_dedup import MIN_PAGES, RATIO

from test_decontaminate import brute as contaminated
from test_ngram_join import brute as linked

D = "/root/testdata/sf0.001"


def boilerplate(rows):
    """(id, text) without the lines that too many pages of their source hold."""
    hosts, holders = {}, {}
    for _, text, source in rows:
        hosts[source] = hosts.get(source, 0) + 1
        for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            holders[source, line] = holders.get((source, line), 0) + 1
    bad = {k for k, n in holders.items() if n >= MIN_PAGES and n > RATIO * hosts[k[0]]}
    for doc, text, source in rows:
        yield doc, None if text is None else "\n".join(x for x in text.split("\n") if (source, x.strip(" \t\r")) not in bad)


def test_names_and_order():
    assert [name for name, _ in P.STAGES] == ["language_id", "boilerplate_lines", "near_duplicates", "benchmark_decontamination", "piece_ids"]


def test_run(spark, tmp_path):
    rows = duckdb.sql(f"select doc_id, text, lang, source from '{D}/documents.parquet' order by doc_id").fetchall()
    items = duckdb.sql(f"select item_id, text from '{D}/benchmark.parquet'").fetchall()
    draw = random.Random(5)
    texts = [r[1] for r in rows if r[1] and 40 < len(r[1].split()) < 400]
    more = []
    for i, kind in enumerate(["copy", "near", "benchmark", None, "", "12 34"] * 2):
        text = draw.choice(texts)
        if kind == "near":
            words = text.split(" ")
            words[len(words) // 2] = "otherword"
            text = " ".join(words)
        elif kind == "benchmark":
            text += "\n" + draw.choice(items)[1]
        elif kind != "copy":
            text = kind
        more.append((10_000 + i, text, "en", f"src{i % 3}"))
    rows += more
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{D}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = langid.fit(spark.read.parquet(str(tmp_path / "documents.parquet")))
    now = [(d, t, s) for d, t, _, s in rows if not model.predict(t)[2]]
    assert len(now) < len(rows)
    now = list(boilerplate(now))
    now = [(d, t) for (d, t), (i, n, c) in zip(now, linked(now), strict=True) if not n or c == d and i == d]
    hit = dict(contaminated(now, items))
    assert any(x[4] for x in hit.values())
    now = [(d, t) for d, t in now if not hit[d][4]]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    got = P.run(spark, str(tmp_path)).select("doc_id", "n_pieces", "round_trip").collect()
    assert sorted((r.doc_id, r.n_pieces) for r in got) == sorted((d, len(library.encode(t or ""))) for d, t in now)
