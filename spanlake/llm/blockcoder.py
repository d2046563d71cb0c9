"""The coder of ``rangecoder`` as functions of columns that run in Spark's own processes, a block at a time.

Its Java source (``blockcoder.java``) is compiled by the compiler that Spark brings along for its generated code, and its
classes go to the executors as a jar. Blocks are the same, byte for byte, as those of ``rangecoder``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import rangecoder

_LOADERS: dict[str, object] = {}


def source() -> str:
    values = {k: int(v) for k, v in vars(rangecoder).items() if k in ("LIMIT", "BITS", "SHARE_BITS", "RATE", "LEAST", "LARGEST", "NONE", "MOST")}
    values |= {"MAGIC": int.from_bytes(rangecoder.MAGIC, "little"), "SLOTS": rangecoder.SLOTS[0]}
    if rangecoder.SLOTS != (values["SLOTS"],) * 2 or rangecoder.WAYS != 4:
        raise ValueError("the coder in Java counts on four ids of a context and as many contexts of both orders")
    constants = "".join(f"    int {k} = {v};\n" for k, v in values.items())
    constants += f"    double RENEW = {rangecoder.RENEW!r};\n    byte[] CLASSES = {{{', '.join(map(str, rangecoder.CLASSES.tolist()))}}};\n"
    return f"package spanlake.blocks;\n\ninterface K {{\n{constants}}}\n\n{Path(__file__).with_suffix('.java').read_text()}"


def loader(spark: SparkSession) -> object:
    """The loader of the compiled classes, which the executors get once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _LOADERS:
        compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source())
        folder = tempfile.mkdtemp(prefix="spanlake-jar-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/spanlake-blocks.jar", "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        context._jsc.addJar(f"{folder}/spanlake-blocks.jar")
        _LOADERS[context.applicationId] = compiler.getClassLoader()
    return _LOADERS[context.applicationId]


def applied(spark: SparkSession, name: str, column: Column, vocabulary: int) -> Column:
    made = loader(spark).loadClass(f"spanlake.blocks.{name}").getDeclaredConstructor(spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Class, 0))
    function = made.newInstance(spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Object, 0))
    binary = spark.sparkContext._jvm.org.apache.spark.sql.types.DataTypes.BinaryType
    spark._jsparkSession.udf().register(f"spanlake_{name}", function, binary)
    return F.call_function(f"spanlake_{name}", column, F.lit(vocabulary))


def encoded(spark: SparkSession, ids: Column, vocabulary: int) -> Column:
    """The block of ids (little-endian unsigned 32-bit integers); fails if one is beyond the vocabulary."""
    return applied(spark, "EncodeBlock", ids, vocabulary)


def decoded(spark: SparkSession, code: Column, vocabulary: int) -> Column:
    """The ids of a block again; fails if it is damaged."""
    return applied(spark, "DecodeBlock", code, vocabulary)
