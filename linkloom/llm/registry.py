"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from .boilerplate import p3_found, p3_main_text
from .copies import _DROPPED, _SHOWN, p4_collapsed, p4_found
from .leaks import p6_found, p6_leaks
from .mixing import p7_mixed, p7_report
from .subjects import p2_composition, p2_found
from .together import p5_found, p5_pairs
from .truncation import p8_found, p8_rates


def queries() -> dict:
    found = (p2_found, p2_composition, p3_found, p3_main_text, p4_found, p4_collapsed, p5_found, p5_pairs, p6_found, p6_leaks, p7_report, p7_mixed, p8_found, p8_rates)
    return {f.__name__: f for f in found}


_TOGETHER = """WITH r AS (SELECT proc_id, any_value(tags) AS tags, any_value(categories) AS categories FROM processed_bookmarks WHERE proc_id IS NOT NULL GROUP BY proc_id),
u AS (SELECT proc_id, 'tags' AS field, unnest(tags) AS x FROM r UNION ALL SELECT proc_id, 'categories', unnest(categories) FROM r),
e AS (SELECT DISTINCT proc_id, field, lower(regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS item FROM u WHERE regexp_matches(x, '[^\\s\\p{Z}]')),
n AS (SELECT count(*) AS n FROM r), i AS (SELECT field, item, count(*) AS c FROM e GROUP BY field, item),
p AS (SELECT a.field, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM e a JOIN e b ON a.proc_id = b.proc_id AND a.field = b.field AND a.item < b.item GROUP BY 1, 2, 3),
c AS (SELECT p.*, x.c AS n_a, y.c AS n_b, n FROM p JOIN i x ON p.field = x.field AND p.item_a = x.item JOIN i y ON p.field = y.field AND p.item_b = y.item, n),
d AS (SELECT *, n_ab + 0.5::DOUBLE AS c0, n_a - n_ab + 0.5::DOUBLE AS c1, n_b - n_ab + 0.5::DOUBLE AS c2, n - n_a - n_b + n_ab + 0.5::DOUBLE AS c3 FROM c) """
_CASES = _TOGETHER + "SELECT field, item_a, item_b FROM c WHERE n_ab >= 6 AND n_ab * 1000 >= n AND n_ab * n >= 4 * n_a * n_b"
_PAIRS = _TOGETHER + "SELECT field, item_a, item_b, n_ab, n_a, n_b, n, n_ab::DOUBLE * n / (n_a::DOUBLE * n_b) AS lift, c0 * c3 / (c1 * c2) AS odds_ratio, sqrt(1 / c0 + 1 / c1 + 1 / c2 + 1 / c3) AS log_odds_error FROM d"

_GRAMS = "SELECT DISTINCT {key}, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}) AS t) AS x"
_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(key='doc_id', table='documents')}) AS d JOIN ({_GRAMS.format(key='item_id', table='eval_items')}) AS i USING (g)"


def _plain(c: str) -> str:
    return f"lower(regexp_replace(upper({c}), '{_DROPPED}', '', 'g'))"


_COPIES = f"""WITH k AS (SELECT bm_seq, {_plain("split_part(split_part(url, '#', 1), '?', 1)")} || array_to_string(list_sort(list_transform(string_split(substr(split_part(url, '#', 1), length(split_part(split_part(url, '#', 1), '?', 1)) + 2), '&'), lambda p: {_plain("p")})), '')
|| {_plain("substr(url, length(split_part(url, '#', 1)) + 1)")} AS u, {_plain("content")} AS t FROM bookmarks WHERE bm_seq IS NOT NULL AND regexp_matches(url, '{_SHOWN}') AND regexp_matches(content, '{_SHOWN}')),
g AS (SELECT u, t, min(bm_seq) AS first_seq, count(*) AS copies FROM k GROUP BY u, t) """


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _COPIES + "SELECT first_seq, bm_seq AS copy_seq FROM k JOIN g USING (u, t) WHERE bm_seq <> first_seq", "p4_collapsed": _COPIES + "SELECT first_seq, copies FROM g",
        "p5_found": _CASES, "p5_pairs": _PAIRS, "p6_found": _LEAKS,
    }
