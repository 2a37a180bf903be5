import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm import test_operators as t
from weir.llm import mixing, packing, quality


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The input and output rows of each stage, written and read again."""
    out, d = [], spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in pipeline.STAGES:
        new = f(spark, d, sf)
        home = spark.conf.get("spark.sql.warehouse.dir") + "/stage-" + name.replace(" ", "-")
        new.write.mode("overwrite").parquet(home)
        out.append((d, spark.read.parquet(home)))
        d = out[-1][1]
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert before.columns == after.columns and before.dtypes == after.dtypes


def test_quality_stage(spark, sf, stages):
    before, after = stages[0]
    kept = {r.doc_id for r in quality.quality(before, quality.trusted_ids(spark, sf)).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept and after.count() == len(kept) > 0


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    expected = {least for _, n, least in t.groups([(r.doc_id, r.text) for r in before.collect()], 5, 80)}
    assert sorted(r.doc_id for r in after.collect()) == sorted(expected)


def test_passage_stage(stages):
    before, after = stages[2]
    cut = {i: (n, g, k) for i, n, g, k in t.cut_words([(r.doc_id, r.text) for r in before.collect()], 50)}
    got = {r.doc_id: r for r in after.collect()}
    assert set(got) == {i for i, (n, g, _) in cut.items() if g == 0 or g < n}
    old = {r.doc_id: r for r in before.collect()}
    for i, r in got.items():
        n, g, k = cut[i]
        assert r.text == (k if g else old[i].text) and (not g or r.n_chars == len(k))


def test_mixing_stage(stages):
    before, after = stages[3]
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_documents(before).where("taken > 0").collect()}
    assert collections.Counter(r.doc_id for r in after.collect()) == taken


def test_packing_stage(stages):
    before, after = stages[4]
    slow = packing.encoder(packing.default_paths()[0], None)
    t.whole_pieces(after.collect(), [(r.doc_id, r.text) for r in before.collect()], slow)


def test_edges(spark, tmp_path):
    # nulls in every column, equal rows and rows of one id, texts long enough to pass the base rules
    random.seed(1)
    text = lambda k, n=70: " ".join(f"w{random.Random(k * 1000 + j).randrange(4000)}" for j in range(n))
    long = [(None, text(1), "en", None, None), (None, text(1), None, "a", 5), (21, text(2), "en", "a", 1), (21, text(2), "en", "a", 1), (22, text(2), None, "b", 2), (23, f"{text(3)} {text(2)}", "en", "b", 3), (24, text(4, 3000), "de", None, 9)]
    docs = spark.createDataFrame([*t.EDGES, *long], t.DOCS)
    labels = spark.createDataFrame([(21, 1, 0), (24, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = lambda d: collections.Counter((r.doc_id, r.text) for r in d.collect())
    quality_out = pipeline.quality_rules(spark, docs, str(tmp_path))
    judged = quality.quality(docs, labels.where("quality = 1").select("doc_id"), carry=("text",))
    assert rows(quality_out) == rows(judged.where("kept")) and sum(rows(quality_out).values()) > 3
    # without the short texts: the next stages see all long ones
    docs = spark.createDataFrame(long, t.DOCS)
    near = pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert rows(near) == collections.Counter([(None, text(1)), (None, text(1)), (21, text(2)), (23, long[5][1]), (24, text(4, 3000))])
    cut = pipeline.repeated_passages(spark, near, str(tmp_path))
    assert rows(cut) == collections.Counter([(None, text(1)), (None, text(1)), (21, text(2)), (23, text(3)), (24, text(4, 3000))])
    mixed = pipeline.source_mix(spark, cut, str(tmp_path))
    taken = collections.Counter()
    for r in mixing.mix_documents(cut, carry=("text",)).where("taken > 0").collect():
        taken[r.doc_id, r.carried_text] += r.taken // r.size
    assert rows(mixed) == taken and {None, 24} <= {k[0] for k in taken}
    packed = pipeline.packed(spark, mixed, str(tmp_path)).collect()
    assert sum(r.length for r in packed ) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert all(before.columns == docs.columns for before in (quality_out, near, cut, mixed))
    none = docs.limit(0)
    for _, f in pipeline.STAGES:
        assert f(spark, none, str(tmp_path)).count() == 0


def test_mixing_keeps_rows_without_id_and_rows_of_one_id(spark, tmp_path):
    rows = [(None, f"no id {i} here", "en", "a", i) for i in range(6)] + [(7, "x " * n, "de", "b", n) for n in range(1, 9)] + [(i, f"text {i}", "en", "b", 1) for i in range(20, 30)] + t.EDGES
    docs = spark.createDataFrame(rows, t.DOCS)
    mix = mixing.mix_documents(docs, carry=("text", "n_chars")).collect()
    expected = collections.Counter()
    for r in mix:
        if r.taken:
            expected[r.doc_id, r.carried_text, r.carried_n_chars] += r.taken // r.size
    assert len(mix) == len(rows) and any(k[0] is None for k in expected)
    out = pipeline.source_mix(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == expected
    # without carry the same rows take the same
    key = lambda r: str((r.doc_id, r.size, r.taken, r.target))
    assert sorted(map(key, mix)) == sorted(map(key, mixing.mix_documents(docs).collect()))


def test_columns_of_any_name_are_carried(spark, sf, tmp_path):
    text = lambda k, n=70: " ".join(f"w{random.Random(k * 1000 + j).randrange(4000)}" for j in range(n))
    rows = [(i, text(i % 4 if i < 8 else i), "en", "a" if i % 3 else None, 7) for i in range(20)]
    names = "kept score n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_removed spans kept_text component_id n_shingles size sources source_size target taken length start offset sequence_id doc_tokens ids_crc32 column_0 column_3 row carried_text _copy _f _w _text _k KEPT".split()
    names = [n for n in names if n != "KEPT"] + ["dotted.name", "Capital"]
    docs = spark.createDataFrame(rows, t.DOCS).select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names])
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = out.collect()
        assert got and all(r[n] == f"{n}-{r.doc_id}" for r in got for n in names), name
    assert pipeline.packed(spark, docs, str(tmp_path)).count() >= 20


def test_rows_of_equal_id_and_text_leave_the_same_one(spark, tmp_path):
    rows = [(1, "a b c d e f g", lang, source, n) for lang in ("en", "de", None) for source in ("x", None) for n in (3, 1)] + [(2, "other words of a different text", "en", "x", 1)]
    got = {tuple(sorted(map(repr, pipeline.near_duplicates(spark, spark.createDataFrame(random.Random(k).sample(rows, len(rows)), t.DOCS).repartition(k + 1), str(tmp_path)).collect()))) for k in range(4)}
    assert len(got) == 1 and len(next(iter(got))) == 2
