"""SQL twins of those queries that SQL can express."""

from __future__ import annotations

from kinspark.llm import secret_scan, url_filter


def secret_scan_sql() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(secret_scan.KINDS):
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT r, source, lang, {rank} AS rank, '{kind}' AS kind, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, {least} AS least FROM d WHERE regexp_matches(t, '{p}')""")
    base = ", ".join(f"'{k}'" for k in secret_scan.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secret_scan.BASE)
    live = f"(n_owners < {secret_scan.WIDELY_COPIED} AND (n_owners < 2 OR n_repos < {secret_scan.WIDELY_HELD}))"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents), found AS ({' UNION ALL '.join(parts)}),
each AS (SELECT r, source, lang, rank, kind, v[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, length(m[i]) AS n, least FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
kept AS (SELECT * FROM each WHERE length(v) >= least), own AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS n_owners, count(DISTINCT coalesce(source, chr(1)) || chr(2) || coalesce(lang, chr(1))) AS n_repos FROM kept GROUP BY v),
judged AS (SELECT kept.*, {live} AS live, kind || ':' || start || ':' || (start + n) AS s FROM kept JOIN own USING (v) WHERE kind IN ({base}) OR {live})
SELECT doc_id, {counts}, sha256(coalesce(string_agg(s, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, rank), '') AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM d LEFT JOIN judged USING (r) GROUP BY r, doc_id"""


def url_filter_sql(rounds: int = 90, damping: float = 0.85) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url, link = url_filter.URL.replace("'", "''"), url_filter.LINK.replace("'", "''")
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v) for v, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{t}'" for f, t, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"

    def walk(name: str, seed: str, edges: str) -> str:
        out = [f"{name}s AS MATERIALIZED (SELECT host, 1.0::DOUBLE / (SELECT count(*) FROM hosts WHERE allowed > 0.5 OR blocked > 0.5) AS weight FROM hosts WHERE {seed} > 0.5)", f"{name}e AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src)::DOUBLE AS share FROM ({edges}))", f"{name}0 AS MATERIALIZED (SELECT host, weight AS rank FROM {name}s)"]
        for i in range(rounds):
            out.append(f"{name}m{i} AS MATERIALIZED (SELECT dst AS host, sum(share * rank) AS got FROM {name}e JOIN {name}{i} ON src = host GROUP BY dst)")
            out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT host, sum(rank) AS rank FROM (SELECT host, got * {damping} AS rank FROM {name}m{i} UNION ALL SELECT host, weight * (1 - {damping} * coalesce((SELECT sum(got) FROM {name}m{i}) / (SELECT sum(weight) FROM {name}s), 0)) FROM {name}s) GROUP BY host)")
        return ", ".join(out)

    return f"""WITH u AS MATERIALIZED (SELECT page_id, html, translate(coalesce(regexp_extract(url, '{url}', 1), ''), '{upper}', '{lower}') AS host, coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages),
j AS MATERIALIZED (SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM u), hosts AS (SELECT host, avg((coalesce(verdict, '') = 'allow')::INT) AS allowed, avg((coalesce(verdict, '') = 'block')::INT) AS blocked FROM j WHERE host <> '' GROUP BY host),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(translate(coalesce(html, ''), '{upper}', '{lower}'), '{link}', 1))), '{upper}', '{lower}') AS dst FROM u) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
{walk('t', 'allowed', 'SELECT src, dst, n FROM edges')}, {walk('b', 'blocked', 'SELECT dst AS src, src AS dst, n FROM edges')}
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN coalesce(b{rounds}.rank, 0) > coalesce(t{rounds}.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(t{rounds}.rank, 0), 6) AS trust, round(coalesce(b{rounds}.rank, 0), 6) AS distrust FROM j LEFT JOIN t{rounds} ON t{rounds}.host = j.host LEFT JOIN b{rounds} ON b{rounds}.host = j.host"""
