"""Original sources out of source maps: inline in the last line, or in a file next to the script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.functions.text import rx

_INLINE = r"//[#@]\s*sourceMappingURL\s*=\s*data:application/json;base64,([A-Za-z0-9+/=]+)\s*$"
_SCHEMA = "struct<sources: array<string>, sourcesContent: array<string>>"


def recover_sources(artifacts: DataFrame, map_files: DataFrame | None = None) -> DataFrame:
    """One row per original file with content.

    ``map_files(path, map_json)`` holds ``<script>.map`` files; a script's own file wins over an
    inline map.
    """
    # only the text after the last newline is looked at
    last = "substring_index(src, '\\n', -1)"
    inline = artifacts.selectExpr(
        "artifact_id", "path",
        f"cast(try_to_binary(nullif(regexp_extract({last}, {rx(_INLINE)}, 1), ''), 'base64') AS string) AS map_json",
    )
    if map_files is not None:
        files = map_files.select(F.col("path").alias("map_path"), F.col("map_json").alias("file_json"))
        joined = inline.join(files, F.concat("path", F.lit(".map")) == F.col("map_path"), "left")
        inline = joined.selectExpr("artifact_id", "path", "coalesce(file_json, map_json) AS map_json")
    parsed = inline.filter("map_json IS NOT NULL").selectExpr(
        "artifact_id", "path", f"from_json(map_json, '{_SCHEMA}') AS map"
    )
    rows = parsed.selectExpr(
        "artifact_id", "path", "posexplode(arrays_zip(map.sources, map.sourcesContent)) AS (source_no, item)"
    )
    return rows.selectExpr(
        "artifact_id", "path", "source_no", "item.sources AS file_name", "item.sourcesContent AS content"
    ).filter("content IS NOT NULL AND file_name IS NOT NULL")
