"""Account of what a scan did not analyse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from codesift.catalog.languages import MAX_FILE_BYTES
from codesift.functions import text as tx
from codesift.operators.deps import toml_as_json
from codesift.operators.facts import unparsed_files

# Manifests that are parsed as a whole, by name.
_JSON = ["Pipfile.lock", "package.json", "package-lock.json", "npm-shrinkwrap.json", "composer.json", "composer.lock", "project.json"]
_TOML = ["pyproject.toml", "Pipfile"]
PARSED_MANIFESTS = _JSON + _TOML


def skipped_files(files: DataFrame, facts: DataFrame | None = None, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """``path, size, reason`` of files that were left out or could not be read:
    too large for the cap (none with ``None``), not text, sources the parser
    gave up on (of ``facts``), and manifests that do not parse; and the paths
    with an ``error`` of ``read_corpus_in_full``."""
    name = tx.base_name(F.col("path"))
    text = F.col("text")
    broken = (name.isin(_JSON) & F.get_json_object(text, "$").isNull()) | (
        name.isin(_TOML) & toml_as_json(F.when(name.isin(_TOML), text)).isNull())
    parts = []
    if "error" in files.columns:
        parts.append(files.where("error IS NOT NULL").select("path", "size", F.col("error").alias("reason")))
        files = files.where("error IS NULL")
    parts += [
        files.where(text.isNull()).select("path", "size", F.lit("not text").alias("reason")),
        files.where(name.isin(PARSED_MANIFESTS) & text.isNotNull()).where(broken).select(
            "path", "size", F.lit("manifest does not parse").alias("reason")),
    ]
    if max_bytes is not None:
        parts.append(files.where(F.col("size") > max_bytes).select("path", "size", F.lit("too large").alias("reason")))
    if facts is not None:
        unparsed = unparsed_files(facts).select("path", F.lit(None).cast("long").alias("size"), F.lit("source does not parse").alias("reason"))
        parts.append(unparsed)
    return reduce(DataFrame.unionByName, parts)


def colliding_ids(files: DataFrame) -> DataFrame:
    """Paths that share a ``file_id`` with another path.

    Ids of ``read_corpus`` are 64-bit digests of paths; among some ten billion
    files a few are expected to meet, and joins on the id would mix them.
    """
    met = files.groupBy("file_id").agg(F.min("path").alias("a"), F.max("path").alias("b")).where("a <> b")
    return files.select("file_id", "path").join(met.select("file_id"), "file_id", "left_semi")
