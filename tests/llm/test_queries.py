"""Registered queries against their SQL, and the pipeline against its parts told in plain Python."""

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from codeloom.llm import bpe
from codeloom.llm.queries import QUERIES
from codeloom.llm.weak_labels import quality
from tests.conftest import TABLES
from tests.llm.samples import documents, frame
from tests.llm.test_dedup import WHITE, brute_exact, brute_near
from tests.llm.test_models import brute_mixture, mixing

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lake():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, lake, name):
    query, sql = QUERIES[name]
    df = query(spark, SF_DIR)
    cols = sorted(df.columns)
    cur = lake.execute(sql)
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    assert len(at) == len(cur.description)
    theirs = [tuple(r[i] for i in at) for r in cur.fetchall()]
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(theirs, key=str) != []


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and len(corpus_pipeline.STAGES) == 5


def test_near_duplicates_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").limit(300).collect()]
    df = frame(spark, [(*r, "en", "s", 1, "d", 1, 2, "k", 3, 4) for r in rows])
    got = corpus_pipeline.near_stage(spark, df, SF_DIR)
    assert {r.doc_id for r in got.collect()} == {i for i, v in brute_near(rows).items() if v[2]}


def test_pipeline_equals_its_stages_in_plain_python(spark, tmp_path):
    """The classifier's verdicts are taken as they are; all that follows is recomputed."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(350).collect()]
    rows += [(90_001, rows[4][1], *rows[4][2:]), (90_002, None, "en", "src1", 0), rows[9], (90_003, "", "en", "src1", 0)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = [tuple(r._doc) for r in quality(docs).filter("kept").collect()]
    assert 0 < len(good) < len(rows)
    best = {x[4]: x[0] for x in brute_exact(good) if x[3]}
    import hashlib

    unique = {r[0]: r for r in good if best[hashlib.sha256(WHITE.sub("", r[1]).encode()).hexdigest()] == r[0]}
    near = brute_near(list(unique.values()))
    apart = [r for i, r in unique.items() if near[i][2]]
    targets = {"source": mixing.SOURCES, "lang": mixing.LANGS, "topic": mixing.TOPICS}
    _, _, p = brute_mixture([r[:4] for r in apart], targets, mixing.BUDGET, mixing.SWEEPS)
    assert p
    drawn = {r._doc.doc_id for r in mixing.mixture(spark.createDataFrame(apart, ", ".join(
        f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))).filter("sampled").collect()}
    library = Tokenizer.from_file(bpe.vocabulary())
    want = {i: library.encode(unique[i][1], add_special_tokens=False).ids for i in drawn}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.token_ids for r in got} == want and len(got) == len(want)
    assert all(r.n_tokens == len(r.token_ids) for r in got)


def test_stages_take_odd_rows_and_empty_tables(spark):
    real = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(200).collect()
    df = frame(spark, documents() + [(1000 + r.doc_id, r.text, r.lang, r.source, 1, "d", 1, 2, "k", 3, 4) for r in real])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, df, SF_DIR)
        assert kept.columns == df.columns and 0 < kept.count() <= df.count()
        assert stage(spark, df.limit(0), SF_DIR).collect() == []
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, df, SF_DIR).count() == df.count() and last(spark, df.limit(0), SF_DIR).collect() == []
