"""Queries for the rule packs and the classifying scanners."""

from __future__ import annotations

from sourcesift.functions.dialect import sql_text
from sourcesift.operators import surface
from sourcesift.operators.matching import scan_rules
from sourcesift.plans import oracle as o
from sourcesift.plans.corpora import mixed_corpus
from sourcesift.plans.registry import Query, add
from sourcesift.rules import extended
from sourcesift.rules import surface as rs
from sourcesift.rules.packs import PACKS

FINDINGS = ["artifact_id", "path", "rule_id", "category", "severity", "value", "context", "pos", "line"]


def _scan(pack: str) -> Query:
    return lambda spark, sf: scan_rules(mixed_corpus(spark, sf), PACKS[pack]).select(*FINDINGS)


for _pack in list(PACKS):
    add(f"scan_{_pack}", _scan(_pack), o.scan_sql(PACKS[_pack]))

# Counters are stated without the rule's pattern: each read of storage is looked at by itself, with
# every ending of the name before it, and the hits that start inside an earlier one fall away.
_READ = "localStorage.getItem"
_NAMED = o.rx(r"(\w+)\s*=\s*(?:parseInt\s*\()?\s*$")
_NEXT, _PLUS = o.rx(r"^[^;]{0,100};\s*(?:[^;]{0,100};\s*){0,3}"), o.rx(r"\s*(?:\+\+|\+=\s*1|\+\s*1)")
RACE_CTE = (
    o.scan_cte([r for r in extended.RACE if r.rule_id != "race-counter"], "race_plain")
    + f""", rc_reads AS (SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT artifact_id, path, src,
      string_split(src, '{_READ}') AS parts FROM corpus WHERE contains(src, '{_READ}'))),
    rc_ends AS (SELECT artifact_id, path, src, array_to_string(parts[1:i], '{_READ}') AS head,
      array_to_string(parts[i + 1:], '{_READ}') AS tail FROM rc_reads),
    rc_names AS (SELECT *, regexp_extract(head, {_NAMED}, 1) AS name,
      length(head) - length(regexp_extract(head, {_NAMED}, 0)) AS begin FROM rc_ends),
    rc_tries AS (SELECT *, substring(name, k + 1) AS word FROM (SELECT *, unnest(range(0, length(name))) AS k FROM rc_names)),
    rc_hits AS (SELECT artifact_id, path, src, begin + k AS pos, word,
      regexp_extract(tail, {_NEXT} || word || {_PLUS}, 0) AS rest, length(head) + {len(_READ)} AS upto FROM rc_tries),
    rc_lists AS (SELECT artifact_id, path, src, list({{'pos': pos, 'word': word, 'stop': upto + length(rest)}} ORDER BY pos) AS c
      FROM rc_hits WHERE rest <> '' GROUP BY ALL),
    rc_kept AS (SELECT artifact_id, path, src, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda kept, x:
      CASE WHEN x[1].pos >= kept[len(kept)].stop THEN list_concat(kept, x) ELSE kept END)) AS h FROM rc_lists),
    rc AS (SELECT artifact_id, path, src, CAST(h.pos AS INTEGER) AS pos, h.word AS word FROM rc_kept),
    race AS (SELECT {o.FINDING_COLUMNS} FROM race_plain UNION ALL SELECT artifact_id, path, 'race-counter', 'Race Condition', 'high',
      'Non-atomic counter: ' || substring(word, 1, 100), {o.one_line(o.win(125, 125))}, pos, {o.line()} FROM rc)"""
)
add(
    "scan_race",
    lambda spark, sf: surface.scan_race(mixed_corpus(spark, sf)).select(*FINDINGS),
    o.with_corpus("mixed", RACE_CTE) + f" SELECT {o.FINDING_COLUMNS} FROM race",
)

_SIGNED = f"(SELECT * FROM corpus WHERE regexp_matches(src, {o.rx(extended.SERVICE_WORKER_SIGNS)}))"
add(
    "scan_service_worker",
    lambda spark, sf: surface.scan_service_worker(mixed_corpus(spark, sf)).select(*FINDINGS),
    o.with_corpus("mixed", o.scan_cte(extended.SERVICE_WORKER, source=_SIGNED))
    + f" SELECT {o.FINDING_COLUMNS} FROM findings",
)

_LABELS = " ".join(
    f"WHEN regexp_matches(m, {o.rx(p)}) THEN {sql_text(label)}" for p, label in rs.PRIVATE_RANGES
)
NETWORK_CTE = (
    o.matches_cte(rs.NETWORK, "nh")
    + f""", np AS (SELECT *, regexp_extract(m, '^https?://([^/]*)', 1) AS authority,
      {o.trim_all(o.one_line(o.win(80, 100)))} AS context, {o.line()} AS line FROM nh),
    nq AS (SELECT *, lower(regexp_extract(authority, '^[^:]*', 0)) AS host,
      regexp_replace(m, '^https?://[^/]*', '') AS url_path,
      regexp_extract(authority, '^[^:]*:?(.*)', 1) AS port FROM np),
    nr AS (SELECT *, (host = '' OR NOT regexp_matches(port, '^[0-9]{{0,5}}$')
        OR coalesce(TRY_CAST(port AS INTEGER), 0) > 65535
        OR (regexp_matches(host, '^[0-9]+([.][0-9]+){{3}}$') AND NOT regexp_matches(host, {o.rx(rs.IPV4)}))) AS malformed,
      regexp_matches(host, {o.rx(rs.CDN_HOSTS)}) AS cdn FROM nq),
    network_raw AS (
      SELECT *, CASE WHEN malformed THEN 'net-malformed-url' WHEN cdn THEN 'net-cdn-url'
        WHEN host IN ('localhost', '127.0.0.1', '0.0.0.0') THEN 'net-internal-url' ELSE 'net-http-url' END AS rid,
        CASE WHEN malformed THEN 'low' WHEN cdn THEN 'info'
        WHEN host IN ('localhost', '127.0.0.1', '0.0.0.0') THEN 'high' ELSE 'info' END AS severity, m AS v
        FROM nr WHERE rule_id = 'url'
      UNION ALL SELECT *, 'net-cloud-meta', 'critical', m FROM nr WHERE rule_id = 'url' AND NOT malformed
        AND NOT cdn AND regexp_matches(host || url_path, {o.rx(rs.METADATA_HOSTS)})
      UNION ALL SELECT *, 'net-ws-url', 'medium', m FROM nr WHERE rule_id = 'ws'
      UNION ALL SELECT *, 'net-graphql', 'medium', m FROM nr WHERE rule_id = 'graphql'
      UNION ALL SELECT *, 'net-api-path', 'info', g1 FROM nr WHERE rule_id = 'api'
      UNION ALL SELECT *, 'net-hostname', 'low', lower(g1) FROM nr WHERE rule_id = 'host'
        AND NOT regexp_matches(lower(g1), {o.rx(rs.COMMON_HOSTS)})
      UNION ALL SELECT *, CASE WHEN (CASE {_LABELS} END) IS NULL THEN 'net-external-ip' ELSE 'net-internal-ip' END,
        CASE WHEN (CASE {_LABELS} END) IS NULL THEN 'low' ELSE 'high' END,
        m || coalesce(' (' || (CASE {_LABELS} END) || ')', '') FROM nr WHERE rule_id = 'ip'
      UNION ALL SELECT *, 'net-cloud-meta-ip', 'critical', m FROM nr WHERE rule_id = 'meta'
      UNION ALL SELECT *, 'net-internal-host', 'medium', lower(m) FROM nr WHERE rule_id = 'internal' AND lower(m) <> 'localhost'),
    network AS (SELECT artifact_id, path, rid AS rule_id, 'Network Surface' AS category, severity,
      substring(v, 1, 120) AS value, context, pos, line FROM network_raw
      QUALIFY row_number() OVER (PARTITION BY artifact_id, rid, v ORDER BY pos) = 1)"""
)
add(
    "scan_network",
    lambda spark, sf: surface.scan_network(mixed_corpus(spark, sf)),
    o.with_corpus("mixed", NETWORK_CTE) + f" SELECT {o.FINDING_COLUMNS} FROM network",
)

add(
    "url_inventory",
    lambda spark, sf: surface.url_inventory(
        spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    ),
    """SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
       lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS host,
       TRY_CAST(nullif(regexp_extract(url, '://[^/:?#]*:([0-9]+)', 1), '') AS INTEGER) AS port,
       regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1) AS url_path FROM pages""",
)
add(
    "url_clusters",
    lambda spark, sf: surface.url_inventory(
        spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    ).groupBy("host").agg({"*": "count"}).withColumnRenamed("count(1)", "n_urls"),
    """SELECT lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS host, count(*) AS n_urls
       FROM pages GROUP BY 1""",
)

_BYTE = (
    "CASE WHEN lower(trim(x)) LIKE '0x%' THEN TRY_CAST('0x' || substring(trim(x), 3) AS INTEGER) "
    "ELSE TRY_CAST(trim(x) AS INTEGER) END"
)
_WASM_CTE = (
    o.matches_cte(rs.WASM, "wh")
    + f""", wp AS (SELECT *, {o.trim_all(o.one_line(o.win(60, 80)))} AS context, {o.line()} AS line,
      CASE rule_id WHEN 'base64' THEN hex(TRY(from_base64(g1))) WHEN 'bytes' THEN
        array_to_string(list_transform(list_filter(list_transform(string_split(g1, ','), lambda x: {_BYTE}),
          lambda n: n BETWEEN 0 AND 255), lambda n: lpad(hex(n), 2, '0')), '') END AS payload FROM wh),
    ws AS (SELECT *, CASE WHEN rule_id <> 'fetch' THEN array_to_string(list_transform(range(0, length(payload) // 2),
        lambda i: CASE WHEN CAST('0x' || substring(payload, i * 2 + 1, 2) AS INTEGER) BETWEEN 32 AND 126
          THEN chr(CAST('0x' || substring(payload, i * 2 + 1, 2) AS INTEGER)) ELSE chr(10) END), '') ELSE '' END AS chars
      FROM wp WHERE rule_id = 'fetch' OR payload LIKE '{rs.WASM_MAGIC}%'),
    wt AS (SELECT DISTINCT artifact_id, path, pos, context, line, unnest(regexp_extract_all(chars, '[ -~]{{4,}}', 0)) AS s FROM ws),
    wasm AS (
      SELECT artifact_id, path, CASE rule_id WHEN 'base64' THEN 'wasm-base64' WHEN 'bytes' THEN 'wasm-bytearray' ELSE 'wasm-fetch' END AS rule_id,
        CASE rule_id WHEN 'fetch' THEN 'info' ELSE 'medium' END AS severity,
        CASE rule_id WHEN 'base64' THEN 'WASM binary (' || CAST(length(payload) // 2 AS VARCHAR) || ' bytes) via base64'
          WHEN 'bytes' THEN 'WASM binary (' || CAST(length(payload) // 2 AS VARCHAR) || ' bytes) via Uint8Array'
          ELSE 'WASM fetched from: ' || g1 END AS value, context, pos, line FROM ws
      UNION ALL SELECT artifact_id, path, 'wasm-url', 'high', 'URL in WASM: ' || unnest(regexp_extract_all(s, {o.rx(r'https?://\S+')}, 0)), context, pos, line FROM wt
      UNION ALL SELECT artifact_id, path, 'wasm-secret', 'medium', 'Potential secret in WASM: ' || substring(k, 1, 30) || '...', context, pos, line
        FROM (SELECT *, unnest(regexp_extract_all(s, {o.rx(r'[A-Za-z0-9_\-]{20,}')}, 0)) AS k FROM wt) WHERE NOT k LIKE 'http%')"""
)
add(
    "scan_wasm",
    lambda spark, sf: surface.scan_wasm(mixed_corpus(spark, sf)),
    o.with_corpus("mixed", _WASM_CTE) + " SELECT *, 'WebAssembly' AS category FROM wasm",
)
