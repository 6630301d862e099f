"""DuckDB SQL for the queries of this folder that SQL can express, over whole tables."""

from __future__ import annotations

from .forms import SHAPES

_FOLD = "lower(strip_accents({0}))"
_WORDS = r"list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"


def _folded(c: str) -> str:
    return _WORDS.format(_FOLD.format(c))


_P1_PAIRS = f"""
WITH once AS (SELECT * FROM corpus_records QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at) = 1),
w AS (SELECT rec_id, split_name, source, array_to_string(list_sort({_folded('entas')}), ' ') a, array_to_string(list_sort({_folded('entbs')}), ' ') b,
        list_distinct({_folded('sentences')}) s FROM once WHERE sentences IS NOT NULL),
k AS (SELECT *, least(a, b) lo, greatest(a, b) hi FROM w WHERE a <> '' AND b <> '' AND len(s) > 0),
p AS (SELECT t.rec_id t_id, h.rec_id h_id, h.split_name split, h.source source, len(list_intersect(t.s, h.s)) n, len(t.s) + len(h.s) u
        FROM k t JOIN k h ON t.lo = h.lo AND t.hi = h.hi
        WHERE t.split_name = 'train' AND h.split_name IN ('validation', 'test') AND len(t.s) >= 0.79 * len(h.s) AND len(h.s) >= 0.79 * len(t.s)),
pairs AS (SELECT * FROM p WHERE 5 * n >= 4 * (u - n))
"""

_P5_TERMS = """
WITH c AS (SELECT * FROM corpus_records QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at) = 1),
k AS (SELECT * FROM kb_relations QUALIFY row_number() OVER (PARTITION BY rel_key ORDER BY loaded_at) = 1),
m AS (SELECT rel_key, unnest(mention) x FROM k),
t AS (SELECT 'relations' field, rec_id id, trim(relations) term FROM c
      UNION ALL SELECT 'sentences', rec_id, unnest(string_split(lower(sentences), ' ')) FROM c
      UNION ALL SELECT 'feature', rel_key, unnest(x.feature) FROM m),
f AS (SELECT * FROM t WHERE term IS NOT NULL AND term <> ''),
n AS (SELECT field, count(DISTINCT id) n_all FROM f GROUP BY 1),
g AS (SELECT field, term, count(*) n_occurrences, count(DISTINCT id) n_records FROM f GROUP BY 1, 2),
terms AS (SELECT field, term, n_occurrences, n_records, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.1 * n_all THEN 'common' END mark FROM g JOIN n USING (field))
"""

_P6 = """
WITH k AS (SELECT * FROM kb_relations QUALIFY row_number() OVER (PARTITION BY rel_key ORDER BY loaded_at) = 1),
m AS (SELECT rel_key, unnest(mention) x FROM k),
i AS (SELECT rel_key, reltype item FROM k WHERE reltype IS NOT NULL UNION SELECT rel_key, item FROM (SELECT rel_key, unnest(x.feature) item FROM m) WHERE item IS NOT NULL),
c AS (SELECT item, count(*) n_i FROM i GROUP BY 1),
p AS (SELECT a.item item_a, b.item item_b, count(*) n_ab FROM i a JOIN i b ON a.rel_key = b.rel_key AND a.item < b.item GROUP BY 1, 2),
s AS (SELECT item_a, item_b, n_ab, ca.n_i n_a, cb.n_i n_b, (SELECT count(*) FROM k) n FROM p JOIN c ca ON ca.item = item_a JOIN c cb ON cb.item = item_b)
"""

_SHAPED = "translate({0}, '" + "".join(SHAPES) + "', '" + "".join(SHAPES.values()) + "')"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_NO_WIDTH = "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]"


def _form(c: str) -> str:
    """Form in SQL, for the alphabets whose accented letters compose."""
    shown = f"regexp_replace(regexp_replace({c}, '{_NO_WIDTH}', '', 'g'), '\\p{{Zs}}', ' ', 'g')"
    shown = f"replace(replace(translate({shown}, '{_WIDE}', '{_PLAIN}'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    return f"nfc_normalize({_SHAPED.format(f'nfc_normalize({shown})')})"


_P9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format('lower(' + _form('text') + ')')} w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format('lower(' + _form('text') + ')')} w FROM eval_items WHERE text IS NOT NULL),
gi AS (SELECT item_id, array_to_string(w[p:p + 12], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) p FROM i)),
gd AS (SELECT doc_id, array_to_string(w[p:p + 12], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) p FROM d)),
found AS (SELECT DISTINCT doc_id, item_id FROM gd JOIN (SELECT DISTINCT item_id, g FROM gi) USING (g))
"""

ORACLE = {
    "p1_found": _P1_PAIRS + "SELECT least(t_id, h_id) rec_id_a, greatest(t_id, h_id) rec_id_b FROM pairs",
    "p1_report": _P1_PAIRS + "SELECT split, source, count(DISTINCT h_id) n_records, count(*) n_pairs FROM pairs GROUP BY 1, 2",
    "p2_found": """
        WITH v AS (SELECT * FROM cells WHERE predicted IS NOT NULL AND NOT isnan(predicted)),
        l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY relation, arg1, arg2 ORDER BY scored_at DESC NULLS LAST, cell_id DESC) = 1)
        SELECT relation, CAST(row_number() OVER w AS INTEGER) rnk, cell_id FROM l
        WINDOW w AS (PARTITION BY relation ORDER BY predicted DESC, arg1 NULLS FIRST, coalesce(arg2, ''), cell_id) QUALIFY row_number() OVER w <= 5""",
    "p5_terms": _P5_TERMS + "SELECT * FROM terms",
    "p5_found": _P5_TERMS + "SELECT field, term, mark FROM terms WHERE mark IS NOT NULL",
    "p6_found": _P6 + "SELECT item_a, item_b FROM s WHERE n_ab >= 5 AND n_ab * n >= 10 * n_a * n_b",
    "p6_scores": _P6 + "SELECT item_a, item_b, n_ab, n_a, n_b, round(n_ab * n / (n_a * n_b), 6) lift FROM s",
    "p9_found": _P9 + "SELECT * FROM found",
    "p9_clean": _P9 + "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)",
    "p10_found": f"""
        WITH f AS (SELECT doc_id, text, {_form('text')} form FROM documents WHERE text IS NOT NULL)
        SELECT a.doc_id doc_id_a, b.doc_id doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text WHERE regexp_matches(a.form, '\\S')""",
}
