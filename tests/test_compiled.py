"""The Java classes are built wherever Python found pyspark, and nothing else needs a compiler."""

from __future__ import annotations

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pyspark

ROOT, HOME = Path(__file__).resolve().parents[1], Path(pyspark.__file__).parent


def python(code: str, **env: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env={**os.environ, **env}, cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)


def test_pyspark_from_its_archive():
    """The driver's Python may load pyspark from a zip, beside which there are no jars."""
    archives = ":".join(str(p) for p in sorted((HOME / "python/lib").glob("*.zip")))
    done = python(
        """
        import pyspark
        assert "pyspark.zip" in pyspark.__file__, pyspark.__file__
        from quadrille.geometry import jts
        from quadrille.session import session
        spark = jts.register(session("local[1]", 1, **{"spark.ui.enabled": "false"}))
        print(spark.sql("SELECT ST_Area(ST_MakeEnvelope(0, 0, 2, 3)) AS a").first()["a"])
        """,
        PYTHONPATH=f"{archives}:{ROOT}", SPARK_HOME=str(HOME),
    )
    assert done.stdout.split()[-1:] == ["6.0"], done.stderr[-2000:]


def test_without_a_compiler(sf):
    done = python(
        f"""
        from quadrille import compiled
        from quadrille.engine import connect
        from quadrille.session import session
        spark = session("local[1]", 1, **{{"spark.ui.enabled": "false"}})
        compiled._in_jvm = compiled._outside = lambda *_: None
        engine = connect({{"s": "{sf}"}}, spark)
        print(engine.sql("SELECT count(*) AS n FROM s.nation WHERE n_name LIKE '%A%'").first()["n"] > 0, engine.describe("s.region")[0][0])
        try:
            engine.sql("SELECT ST_Area(ST_MakeEnvelope(0, 0, 2, 3)) AS a")
        except compiled.CompilerMissing:
            print("missing")
        """
    )
    assert done.stdout.split()[-3:] == ["True", "r_regionkey", "missing"], done.stderr[-2000:]
