"""DuckDB SQL for the queries that SQL can express, by brute force."""

from __future__ import annotations


def _components(links: str, nodes: str, node: str) -> str:
    """CTEs reach(x, y) and component(x, c) over links(a, b)."""
    return (
        f"both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}), "
        f"reach AS (SELECT {node} AS x, {node} AS y FROM {nodes} UNION SELECT r.x, l.b FROM reach r JOIN both_ways l ON r.y = l.a), "
        "component AS (SELECT x, min(y) AS c FROM reach GROUP BY x)"
    )


def near_duplicates(words: int, over: int, under: int) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return (
        "WITH RECURSIVE cut AS (SELECT doc_id, list_filter(string_split_regex("
        f"translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents), "
        f"sets AS (SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {shingle})) "
        "WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM cut), "
        "each AS (SELECT doc_id, unnest(s) AS g FROM sets), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets), "
        "common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM each p JOIN each q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY ALL), "
        f"links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE {under} * k >= {over} * (x.n + y.n - k)), "
        f"{_components('links', 'sizes', 'doc_id')} "
        "SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM sizes JOIN component ON x = doc_id"
    )


def embedding_near_duplicates(cosine: float) -> str:
    return (
        "WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL "
        "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
        f"links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND p.vec_id < q.vec_id WHERE list_cosine_similarity(p.v, q.v) >= {cosine}), "
        f"{_components('links', 'embeddings', 'vec_id')}, degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a) "
        "SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN component ON x = vec_id LEFT JOIN degree ON a = vec_id"
    )


def personal_data_base(table: str = "documents") -> str:
    """The plain matches of ``personal_data_report``: all its columns but spans, n_added and n_spans."""
    # The patterns of the contract.
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT), 256) > 255)) = 0"),
        "card": (r"[0-9]([\x20-]?[0-9])+", "length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 12 AND 19 AND {luhn} % 10 = 0"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
    }
    digits = "string_split(reverse(regexp_replace(x, '[^0-9]', '', 'g')), '')"
    luhn = f"list_sum(list_transform({digits}, lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INT) WHEN d > '4' THEN 2 * CAST(d AS INT) - 9 ELSE 2 * CAST(d AS INT) END))"
    columns, parts = [], []
    for n, (pattern, passes) in enumerate(kinds.values()):
        columns.append(f"regexp_extract_all(t, '{pattern}', 0) AS m{n}, string_split_regex(t, '{pattern}') AS b{n}")
        begin = f"CAST(coalesce(list_sum(list_transform(b{n}[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m{n}[1:i-1], lambda y: length(y))), 0) AS BIGINT)"
        places = f"list_transform(range(1, len(m{n}) + 1), lambda i: {{'a': {begin}, 'k': {n}, 'b': {begin} + length(m{n}[i]), 'x': m{n}[i]}})"
        passes = passes.replace("{luhn}", luhn).replace("(x, ", "(s.x, ")
        parts.append(f"list_filter({places}, lambda s: {passes})")
    joined = f"list_concat(list_concat({parts[0]}, {parts[1]}), list_concat({parts[2]}, {parts[3]}))"
    names = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    counts = ", ".join(f"CAST(len(list_filter(s, lambda x: x.k = {n})) AS BIGINT) AS n_{k}" for n, k in enumerate(kinds))
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}), e AS (SELECT doc_id, {', '.join(columns)} FROM d), f AS (SELECT doc_id, list_sort({joined}) AS s FROM e) "
        f"SELECT doc_id, {counts}, sha256(array_to_string(list_transform(s, lambda x: {names}[x.k + 1] || ':' || x.a || ':' || x.b), ',')) AS base_sha256 FROM f"
    )


def nearest_neighbours(k: int, every: int) -> str:
    """The exact neighbours that the approximate search is measured against."""
    return (
        "WITH good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL "
        "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
        "near AS (SELECT q.vec_id AS query_id, p.vec_id, list_cosine_similarity(q.v, p.v) AS score FROM good q JOIN good p ON q.vec_id <> p.vec_id WHERE q.vec_id % "
        f"{every} = 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank, vec_id, score FROM near QUALIFY rank <= {k}"
    )
