"""Registry of the training-text queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import encoding, knn, leakage, mixing, neardup, spans, splitting


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": encoding.p1_found,
        "p1_repaired": encoding.p1_repaired,
        "p2_found": knn.p2_found,
        "p2_neighbours": knn.p2_neighbours,
        "p4_found": neardup.p4_found,
        "p4_classes": neardup.p4_classes,
        "p4_groups": neardup.p4_groups,
        "p5_found": splitting.p5_found,
        "p5_pieces": splitting.p5_pieces,
        "p6_found": leakage.p6_found,
        "p6_leaks": leakage.p6_leaks,
        "p7_selection": mixing.p7_selection,
        "p7_report": mixing.p7_report,
        "p8_found": spans.p8_found,
        "p8_spans": spans.p8_spans,
        "p8_classes": spans.p8_classes,
        "p8_shares": spans.p8_shares,
    }


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _grams(n: int, words: str) -> str:
    return "list_distinct(list_transform(range(1, greatest(len(" + words + f") - {n - 2}, 1)), lambda i: array_to_string(" + words + f"[i:i + {n - 1}], ' ')))"


def oracle_sql() -> dict[str, str]:
    """Brute force over whole tables; what SQL cannot say or finish is tested on small fixtures instead."""
    return {
        "p2_found": """with v as (select distinct on (chunk_id) chunk_id as c, embedding::double[] as e from vec_chunks where len(embedding) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0 order by chunk_id),
            s as (select a.c as a, b.c as b, row_number() over (partition by a.c order by list_cosine_similarity(a.e, b.e) desc, b.c) as k from v a join v b on a.c <> b.c)
            select distinct least(a, b) as chunk_a, greatest(a, b) as chunk_b from s where k <= 5""",
        "p4_found": f"""with w as (select distinct on (chunk_id) chunk_id as c, {_WORDS} as w from chunks where text is not null order by chunk_id),
            g as (select c, {_grams(3, "w")} as g from w where len(w) >= 20), x as (select c, len(g) as n, unnest(g) as t from g),
            p as (select a.c as a, b.c as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k from x a join x b on a.t = b.t and a.c < b.c group by 1, 2)
            select a as chunk_a, b as chunk_b from p where 2 * k >= na + nb - k""",
        "p5_found": "select distinct chunk_id from chunks where length(text) > 2000",
        "p6_found": f"""with d as (select doc_id, {_WORDS} as w from documents where text is not null), i as (select item_id, {_WORDS} as w from eval_items),
            dg as (select doc_id, unnest({_grams(13, "w")}) as t from d where len(w) >= 13), ig as (select item_id, unnest({_grams(13, "w")}) as t from i where len(w) >= 13)
            select distinct doc_id, item_id from dg join ig using (t)""",
        "p8_found": """with x as (select distinct doc_id, hash(substr(text, i::int, 300)) as h from (select doc_id, text, unnest(range(1, length(text) - 298)) as i from documents where length(text) >= 300))
            select distinct a.doc_id as doc_a, b.doc_id as doc_b from x a join x b on a.h = b.h and a.doc_id < b.doc_id""",
    }
