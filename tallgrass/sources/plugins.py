"""Plugins: Python functions registered as table functions that give code elements for a file."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = "name string, element_type string, line_number int, language string"


def register(spark: SparkSession, name: str, analyse: Callable[[str, str], Iterable[tuple]]) -> None:
    """Registers analyse(path, content) -> rows (name, element_type, line_number, language). A file that fails gives no rows."""

    class Plugin:
        def eval(self, path: str, content: str):
            try:
                rows = list(analyse(path, content))
            except Exception:  # a plugin is foreign code: its failure means no rows, as its contract says
                rows = []
            yield from rows

    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(Plugin, returnType=ELEMENTS))


def plugin_elements(files: DataFrame, name: str) -> DataFrame:
    """The plugin's rows for each file."""
    spark = files.sparkSession
    return spark.sql(f"SELECT f.repository_id, f.path AS file_path, p.* FROM {{files}} f, LATERAL {name}(f.path, f.content) p", files=files.select("repository_id", "path", "content"))


def decoded(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements and relationships from JSON that external plugins print (a column `value`); what is no such JSON gives nothing."""
    schema = "decoder_format struct<code_elements:array<struct<name:string,element_type:string,file_path:string,line_number:int>>,code_relationships:array<struct<source:string,target:string,relationship_type:string>>>"
    d = documents.select(F.from_json("value", schema)["decoder_format"].alias("d"))
    return d.select(F.inline("d.code_elements")), d.select(F.inline("d.code_relationships"))
