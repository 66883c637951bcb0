"""DuckDB SQL for those corpus operators whose results SQL can state."""

from __future__ import annotations

_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
_INTEGERS = "list_transform(embedding, lambda x: floor(1024 * x::double)::bigint)"

OP2 = f"""with v as (select vec_id, {_INTEGERS} e from embeddings where {_FINITE})
, s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10"""

#: Base 32 of a SHA-1: each letter stands for five bits, taken from two hexadecimal digits.
OP11 = """with h as (select page_id, octet_length(encode(coalesce(html, '')))::bigint payload_bytes, sha1(coalesce(html, '')) x from pages)
, d as (select page_id, payload_bytes, x, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((strpos('0123456789abcdef', substr(x, (5 * i // 4 + 1)::int, 1)) - 1) * 16
 + greatest(strpos('0123456789abcdef', substr(x || '0', (5 * i // 4 + 2)::int, 1)) - 1, 0)) // (2 ** (3 - 5 * i % 4))::int) % 32 + 1)::int, 1)), 'string_agg', '') payload_digest from h)
, m as (select *, max(page_id) over (partition by x) top from d)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end record_type, case when page_id <> top then top end refers_to from m"""


def lloyd(rounds: int = 10, centroids: int = 8) -> str:
    """Rounds of assignment and floor of the mean, one after another."""
    parts = [
        f"v as materialized (select vec_id, {_INTEGERS} e from embeddings where len(embedding) = 64 and {_FINITE})",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || vec_id)) - 1 k, e from v qualify k < {centroids})",
    ]
    for r in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
        parts.append(f"a{r} as materialized (select vec_id, arg_min(k, (d, k)) k, min(d) d from (select vec_id, k, {apart} d from v, c{r} c) group by vec_id)")
        if r < rounds:
            means = f"select k, list(x order by i) e from (select k, i, floor(sum(e[i])::double / count(*))::bigint x from a{r} join v using (vec_id), range(1, 65) g(i) group by k, i) group by k"
            parts.append(f"c{r + 1} as materialized (select k, coalesce(n.e, o.e) e from c{r} o left join ({means}) n using (k))")
    return f"""with {", ".join(parts)} select vec_id, k::int as cluster, d distance, (sum(d) over (partition by k))::bigint cluster_inertia, (sum(d) over ())::bigint inertia,
 sha256(list_aggregate(c.e, 'string_agg', ',')) centroid_sha256 from a{rounds} join c{rounds} c using (k)"""


ORACLE_SQL: dict[str, str] = {"op2_exact_top_k": OP2, "op11_warc": OP11, "op13_lloyd": lloyd()}
