"""SQL functions, signed tokens, settings, sources and sinks, streams, and the import guard."""

import json
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridlume.config import Settings, duration
from gridlume.functions import signing, sql
from gridlume.operators import features, paging
from gridlume.sources import keyed, landing, sinks
from gridlume.streaming import twins

ROOT = Path(__file__).resolve().parent.parent


def test_sql_functions(spark):
    assert set(sql.register(spark)) == set(sql.FUNCTIONS)
    row = spark.sql("select normalize_street('12 R. de Longchamp') a, js_number(' 5 ') b, french_millis('31/02/2026 10:00') = french_millis('03/03/2026 10:00') c, duration_seconds('7d') d, department_code('97411') e").first()
    assert tuple(row) == ("RUE DE LONGCHAMP", 5, True, 604800, "974")


def test_tokens(spark):
    df = spark.createDataFrame([('{"a":1}',), (None,), ("é",)], "p string").withColumn("t", signing.sign(F.col("p"), "k" * 32))
    got = df.select("p", "t", signing.verify(F.col("t"), "k" * 32).alias("v"), signing.verify(F.concat("t", F.lit("x")), "k" * 32).alias("bad"), signing.verify(F.col("t"), "other").alias("other")).collect()
    assert all(r.v == r.p and r.bad is None and r.other is None for r in got)


def test_settings():
    assert Settings.load({}).fact_ttl == 900 and Settings.load({"GRIDLUME_FACT_TTL": "2h"}).fact_ttl == 7200
    with pytest.raises(ValueError, match="https"):
        Settings.load({"GRIDLUME_MODE": "production", "GRIDLUME_ORIGIN": "https://x.example/", "GRIDLUME_CURSOR_SECRET": "s" * 32})
    assert Settings.load({"GRIDLUME_MODE": "production", "GRIDLUME_ORIGIN": "https://x.example", "GRIDLUME_CURSOR_SECRET": "s" * 32}).production
    assert duration("x", 3) == 3 and duration("0.5s", 3) == 0.5


def test_landing(spark, tmp_path):
    for name, body in (("75056", '{"resultMegacache": {"compteurBT": 3}}'), ("69001", "{oops")):
        (tmp_path / f"insee={name}").mkdir()
        (tmp_path / f"insee={name}" / "r.json").write_text(body)
    got = {r.insee: (r.error, r.report and r.report.resultMegacache.compteurBT) for r in landing.report_landing(spark, f"file://{tmp_path}").collect()}
    assert got == {"75056": (None, "3"), "69001": ("invalid response", None)}


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "é")], "a int, b string, c string").select("*", *sinks.metadata(source="x"))
    sinks.write_json(df, f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.endswith("\n") and json.loads(text) == {"a": 1, "c": "é", "source": "x"}


def test_versions(spark):
    df = spark.createDataFrame([('{"version":3,"x":1}',), ('{"version":2,"x":1}',), ("bad",), (None,)], "v string")
    assert [r[0] and r[0].x for r in df.select(keyed.versioned(F.col("v"), "version int, x int", 3)).collect()] == [1, None, None, None]


def test_batch_key(spark):
    got = spark.range(1).select(keyed.batch_key("g", F.lit("b"), F.array(F.lit("RUE A")))).first()[0]
    assert got == "g:b:0730d15b5c769c17b42eff83649ef8a19d240766ef2a055fd83018643eac3451"


def test_label_order(spark):
    df = spark.createDataFrame([(x,) for x in "ZfÉEeAa"], "label string").withColumn("key", F.col("label"))
    assert "".join(r.label for r in paging.by_label(df).collect()) in ("aAeEÉfZ",)


def test_headline(spark):
    assert spark.range(1).select(features.headline(F.lit(2), F.lit(None).cast("int"))).first()[0] == 2


def test_streams(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [(i, "a" if i % 3 else "b", t + timedelta(seconds=20 * i)) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, k string, ts timestamp")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    assert twins.drain(twins.coalesce_stream(stream, "k", "ts", "1 hour"), "first").count() == 2
    assert twins.drain(twins.rate_counts(stream, "k", "ts", 60, "1 minute"), "rate").count() >= 2


def test_without_the_llm_folders(tmp_path):
    """The entry module imports and the other queries stay when the corpus parts are gone; a broken one is not hidden."""
    import shutil

    for name in ("gridlume", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "gridlume/llm", ignore_errors=True)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    n, has_ops = run.stdout.split()
    assert int(n) > 60 and has_ops == "False"


def test_nothing_else_imports_llm():
    for p in (ROOT / "gridlume").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "gridlume").parts:
            assert "gridlume.llm" not in p.read_text(), p
