"""Scanners that classify what a pattern found: service workers, network addresses, WebAssembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.functions.text import matches, one_line, quote, rx, trim_all
from sourcesift.operators.matching import explode_matches, scan_rules
from sourcesift.rules import extended
from sourcesift.rules import surface as s


def first_occurrence(df: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Each key once, with the columns of its earliest row; repeats merge before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    first = F.min(F.struct(order, *rest)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, "first.*").select(*df.columns)


def scan_race(artifacts: DataFrame) -> DataFrame:
    return scan_rules(artifacts, extended.RACE)


def scan_service_worker(artifacts: DataFrame) -> DataFrame:
    """Service-worker rules behind a quick test for any sign of one."""
    return scan_rules(
        artifacts.filter(matches("src", extended.SERVICE_WORKER_SIGNS)), extended.SERVICE_WORKER
    )


def scan_network(artifacts: DataFrame) -> DataFrame:
    """Addresses by kind: URL host class, sockets, API paths, hosts, IPs, metadata services."""
    hits = explode_matches(
        artifacts, s.NETWORK, windows={"w": (80, 100)}, line=True
    ).selectExpr(
        "artifact_id", "path", "rule_id AS kind", "m", "g1", "pos", "line",
        f"{trim_all(one_line('w'))} AS context",
        "regexp_extract(m, '^https?://([^/]*)', 1) AS authority",
    )
    hits = hits.selectExpr(
        "*",
        "lower(regexp_extract(authority, '^[^:]*', 0)) AS host",
        "regexp_replace(m, '^https?://[^/]*', '') AS url_path",
        "regexp_extract(authority, '^[^:]*:?(.*)', 1) AS port",
    )
    malformed = (
        "(host = '' OR NOT port RLIKE '^[0-9]{0,5}\\\\z' OR coalesce(try_cast(port AS int), 0) > 65535 "
        f"OR (host RLIKE '^[0-9]+([.][0-9]+){{3}}\\\\z' AND NOT host RLIKE {rx(s.IPV4)}))"
    )
    labels = " ".join(f"WHEN m RLIKE {rx(p)} THEN {quote(label)}" for p, label in s.PRIVATE_RANGES)
    hits = hits.selectExpr("*", f"{malformed} AS malformed", f"CASE {labels} END AS private_label")
    rows = f"""CASE kind
      WHEN 'url' THEN array_compact(array(
        CASE WHEN malformed THEN struct('net-malformed-url' AS rule_id, 'low' AS severity, m AS value)
             WHEN host RLIKE {rx(s.CDN_HOSTS)} THEN struct('net-cdn-url' AS rule_id, 'info' AS severity, m AS value)
             WHEN host IN ('localhost', '127.0.0.1', '0.0.0.0') THEN struct('net-internal-url' AS rule_id, 'high' AS severity, m AS value)
             ELSE struct('net-http-url' AS rule_id, 'info' AS severity, m AS value) END,
        CASE WHEN NOT malformed AND NOT host RLIKE {rx(s.CDN_HOSTS)} AND concat(host, url_path) RLIKE {rx(s.METADATA_HOSTS)}
             THEN struct('net-cloud-meta' AS rule_id, 'critical' AS severity, m AS value) END))
      WHEN 'ws' THEN array(struct('net-ws-url' AS rule_id, 'medium' AS severity, m AS value))
      WHEN 'graphql' THEN array(struct('net-graphql' AS rule_id, 'medium' AS severity, m AS value))
      WHEN 'api' THEN array(struct('net-api-path' AS rule_id, 'info' AS severity, g1 AS value))
      WHEN 'host' THEN CASE WHEN NOT lower(g1) RLIKE {rx(s.COMMON_HOSTS)}
        THEN array(struct('net-hostname' AS rule_id, 'low' AS severity, lower(g1) AS value)) END
      WHEN 'ip' THEN array(CASE WHEN private_label IS NOT NULL
        THEN struct('net-internal-ip' AS rule_id, 'high' AS severity, concat(m, ' (', private_label, ')') AS value)
        ELSE struct('net-external-ip' AS rule_id, 'low' AS severity, m AS value) END)
      WHEN 'meta' THEN array(struct('net-cloud-meta-ip' AS rule_id, 'critical' AS severity, m AS value))
      WHEN 'internal' THEN CASE WHEN lower(m) != 'localhost'
        THEN array(struct('net-internal-host' AS rule_id, 'medium' AS severity, lower(m) AS value)) END
    END"""
    found = hits.selectExpr("artifact_id", "path", "context", "pos", "line", f"inline({rows})")
    found = first_occurrence(found, ["artifact_id", "path", "rule_id", "severity", "value"])
    return found.selectExpr(
        "artifact_id", "path", "rule_id", "'Network Surface' AS category", "severity",
        "substring(value, 1, 120) AS value", "context", "pos", "line",
    )


def url_inventory(rows: DataFrame, url: str = "url") -> DataFrame:
    """URL column -> scheme, host, port and path per row."""
    return rows.selectExpr(
        *rows.columns,
        f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme",
        f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) AS host",
        f"try_cast(nullif(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]*:([0-9]+)', 1), '') AS int) AS port",
        f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS url_path",
    )


def scan_wasm(artifacts: DataFrame) -> DataFrame:
    """Embedded WebAssembly payloads, and the addresses and secrets among their strings."""
    hits = explode_matches(artifacts, s.WASM, windows={"w": (60, 80)}, line=True)
    number = (
        "CASE WHEN lower(trim(x)) LIKE '0x%' THEN cast(conv(substring(trim(x), 3), 16, 10) AS int) "
        "ELSE try_cast(trim(x) AS int) END"
    )
    listed = (
        f"array_join(transform(filter(transform(split(g1, ','), x -> {number}), "
        "n -> n BETWEEN 0 AND 255), n -> lpad(hex(n), 2, '0')), '')"
    )
    hits = hits.selectExpr(
        "artifact_id", "path", "rule_id AS kind", "g1", "pos", "line",
        f"{trim_all(one_line('w'))} AS context",
        f"CASE rule_id WHEN 'base64' THEN hex(try_to_binary(g1, 'base64')) WHEN 'bytes' THEN {listed} END AS payload",
    ).filter(f"kind = 'fetch' OR payload LIKE '{s.WASM_MAGIC}%'")
    strings = "array_distinct(regexp_extract_all(decode(unhex(payload), 'ISO-8859-1'), '[\\\\x20-\\\\x7e]{4,}', 0))"
    hits = hits.selectExpr(
        "*",
        f"CASE WHEN kind != 'fetch' THEN array_join({strings}, '\\n') ELSE '' END AS strings",
        "cast(length(payload) / 2 AS int) AS n_bytes",
    )
    urls = f"regexp_extract_all(strings, {rx(r'https?://\S+')}, 0)"
    keys = f"filter(regexp_extract_all(strings, {rx(r'[A-Za-z0-9_\-]{20,}')}, 0), k -> NOT k LIKE 'http%')"
    rows = f"""concat(
      array(CASE kind
        WHEN 'base64' THEN struct('wasm-base64' AS rule_id, 'medium' AS severity, concat('WASM binary (', n_bytes, ' bytes) via base64') AS value)
        WHEN 'bytes' THEN struct('wasm-bytearray' AS rule_id, 'medium' AS severity, concat('WASM binary (', n_bytes, ' bytes) via Uint8Array') AS value)
        ELSE struct('wasm-fetch' AS rule_id, 'info' AS severity, concat('WASM fetched from: ', g1) AS value) END),
      transform({urls}, u -> struct('wasm-url' AS rule_id, 'high' AS severity, concat('URL in WASM: ', u) AS value)),
      transform({keys}, k -> struct('wasm-secret' AS rule_id, 'medium' AS severity,
        concat('Potential secret in WASM: ', substring(k, 1, 30), '...') AS value)))"""
    return hits.selectExpr(
        "artifact_id", "path", "context", "pos", "line", f"inline({rows})", "'WebAssembly' AS category"
    )
