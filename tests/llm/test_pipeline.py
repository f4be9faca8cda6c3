"""The pipeline's stages: decisions take effect, columns stay, clean documents are kept, and the whole equals plain code."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from brute import contains, line_dedup, linked, prose, quality_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Clean texts in lines, near and exact copies, passages that several have, a benchmark item, junk, and empty ones."""
    rng = np.random.default_rng(77)
    passage = "\n".join(prose(700 + i, 9) for i in range(4))
    rows = []
    for i in range(44):
        lines = [prose(3000 + 20 * i + k, 12) for k in range(7)]
        if i % 5 == 2:
            lines[3:3] = passage.split("\n")
        rows.append(("\n".join(lines), "en" if i < 40 else "de"))
    rows += [(rows[3][0] + " more words", "en"), (rows[3][0], "en"), (rows[9][0].replace("\n", " "), "en"), (rows[7][0].upper(), "en")]
    rows.append((prose(7, 60) + " " + prose(999, 45), "en"))
    rows.append(("".join(chr(97 + int(c)) if c < 26 else " " for c in rng.integers(0, 30, 900)), "en"))
    rows += [("too short", "en"), (None, None), ("", "en"), ("again and again " * 40, "en")]
    return [(i, t, lang, f"src{i % 3}", None if t is None else len(t)) for i, (t, lang) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(999, 45)), (2, None), (3, "nowhere to be found at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_equals_plain_code(spark, folder):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    from tessaria.llm import byte_bpe

    rows = corpus()
    _, kept = quality_of([(t, lang) for _, t, lang, _, _ in rows], 20)
    texts = line_dedup({i: t for i, t, *_ in rows if kept[i]})
    ids = sorted(texts)
    _, root = linked([texts[i] for i in ids], 5, 80)
    texts = {i: texts[i] for k, i in enumerate(ids) if root[k] == k}
    texts = {i: t for i, t in texts.items() if not contains(t, prose(999, 45))}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(texts) and set(range(40)) <= set(got) and 30 < len(got) < len(rows)
    assert 46 not in got and not set(range(48, 54)) & set(got)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.default_path()), special_tokens={})
    for i, t in texts.items():
        ids = np.array(own.encode_ordinary(t), dtype="<u4")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert got[i]["n_chars"] == len(t) and got[i]["lang"] == rows[i][2]


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "byte-level BPE" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
