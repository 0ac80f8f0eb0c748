import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ["duplicate_claims", "blocking_stats", "duplicate_groups", "prf_by_band", "calibration", "risk_coverage", "review_queue", "tfidf_cosine"]
NAMES += ["pair_reasons", "regrouped", "flags_after_rescore", "workflow_state", "gstin_checks", "corrected_fields", "extraction_report", "amounts_check", "reading_scores"]


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    fmt = lambda v: round(float(v), 6) if v.__class__.__name__ in ("float", "Decimal") else v
    got = sorted(str([fmt(r[c]) for c in cols]) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in res.description]
    want = sorted(str([fmt(r[at.index(c)]) for c in cols]) for r in res.fetchall())
    assert got == want


def test_streaming_screen(spark, sf_dir, tmp_path):
    from docketry.plans import adapter as A
    from docketry.streaming import screen

    claims = A.claims(spark, sf_dir)
    claims.where(f"claim_id < {A.COPY}").write.parquet(str(tmp_path / "old" / "batch=-1"))
    claims.where(f"claim_id >= {A.COPY}").write.parquet(str(tmp_path / "new"))
    stream = spark.readStream.schema(claims.schema).parquet(str(tmp_path / "new"))
    q = screen.screen_new_claims(stream, str(tmp_path / "old"), str(tmp_path / "flags"), str(tmp_path / "ck"))
    q.awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "flags")).where("band = 'EXACT'").count() > 0
