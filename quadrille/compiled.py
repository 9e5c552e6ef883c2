"""Java sources of this package, compiled for the running session and handed to its executors.

The class path is the running JVM's own, so the classes meet the Spark that will call them wherever Python found pyspark.
The compiler is the JVM's, or else ``javac`` on ``PATH`` or in ``JAVA_HOME``; each driver process compiles a source once,
in a folder that only its user can read.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_jars: dict[str, str] = {}


class CompilerMissing(RuntimeError):
    """No Java compiler: what needs compiled classes is unavailable, everything else works."""


def class_path(spark: SparkSession) -> str:
    """The JVM's class path and the folder of Spark's own jars."""
    jvm = spark.sparkContext._jvm
    parts = [p for p in jvm.java.lang.System.getProperty("java.class.path").split(os.pathsep) if p]
    code = jvm.java.lang.Class.forName("org.apache.spark.sql.api.java.UDF1").getProtectionDomain().getCodeSource()
    if code is not None:
        parts.append(os.path.join(os.path.dirname(code.getLocation().getPath()), "*"))
    return os.pathsep.join(parts)


def _in_jvm(spark: SparkSession, arguments: list[str]) -> str | None:
    """Messages of the JVM's own compiler if it failed, empty if not; None where the JVM has no compiler."""
    jvm = spark.sparkContext._jvm
    if jvm.javax.tools.ToolProvider.getSystemJavaCompiler() is None:
        return None
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.String, len(arguments))
    for i, a in enumerate(arguments):
        args[i] = a
    said = jvm.java.io.StringWriter()
    code = jvm.com.sun.tools.javac.Main.compile(args, jvm.java.io.PrintWriter(said))
    return "" if code == 0 else said.toString() or "no message"


def _outside(arguments: list[str]) -> str | None:
    """The same by a ``javac`` process."""
    home = os.environ.get("JAVA_HOME")
    javac = shutil.which("javac") or (home and shutil.which("javac", path=f"{home}/bin"))
    if not javac:
        return None
    done = subprocess.run([javac, *arguments], capture_output=True, text=True, check=False)
    return "" if done.returncode == 0 else done.stderr or done.stdout or "javac failed"


def jar(spark: SparkSession, source: Path) -> str:
    """Path of a jar with the classes of ``source``."""
    text = source.read_bytes()
    key = hashlib.sha256(text).hexdigest()[:16]
    if key in _jars and os.path.exists(_jars[key]):
        return _jars[key]
    folder = Path(tempfile.mkdtemp(prefix="quadrille-java-")).resolve()
    classes = folder / "classes"
    classes.mkdir()
    (folder / source.name).write_bytes(text)  # the package itself may lie in an archive
    arguments = ["-nowarn", "-proc:none", "-d", str(classes), "-cp", class_path(spark), str(folder / source.name)]
    said = _in_jvm(spark, arguments)
    if said is None:
        said = _outside(arguments)
    if said is None:
        raise CompilerMissing(f"{source.name} needs a Java compiler: a JDK, or javac on PATH or in JAVA_HOME of the driver")
    if said:
        raise RuntimeError(f"{source.name} does not compile: {said}")
    made = folder / f"{source.stem.lower()}-{key}.jar"
    with zipfile.ZipFile(made, "w") as out:
        for f in sorted(classes.rglob("*.class")):
            out.write(f, f.relative_to(classes))
    _jars[key] = str(made)
    return _jars[key]


def add(spark: SparkSession, source: Path) -> None:
    """Compile ``source`` and add its classes to the session; executors fetch them from the driver."""
    spark.sql(f"ADD JAR '{jar(spark, source)}'")
