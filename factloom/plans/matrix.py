"""Queries of the cell matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cells as C
from ..operators import sampling, supervision
from ..sources.tables import table

PREDICT = ["path#", "REL$"]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells")


def cells_frequency_filter(spark: SparkSession, d: str) -> DataFrame:
    """[P4] Two-stage frequency filter."""
    out = C.frequency_filter(_cells(spark, d), 10, 2, PREDICT)
    return out.select("cell_id", "relation", "arg1", "arg2", "n_rel", "n_tuple")


def relation_roles(spark: SparkSession, d: str) -> DataFrame:
    """[P1, P5] Cells by namespace and role."""
    c = _cells(spark, d).select(text.namespace(F.col("relation")).alias("ns"), C.role_of(F.col("relation"), ["ner#"], ["REL$"], ["unary#"]).alias("role"))
    return c.groupBy("ns", "role").agg(F.count(F.lit(1)).alias("n"))


def cell_roles(spark: SparkSession, d: str) -> DataFrame:
    """Training, unlabelled and test cells."""
    return C.roles(_cells(spark, d)).groupBy("training", "unlabeled", "test").agg(F.count(F.lit(1)).alias("n"))


def negative_label_sample(spark: SparkSession, d: str) -> DataFrame:
    """[P3] Tuples labelled NA keep their labels for each fourth cell only."""
    out = C.sample_negative_labels(_cells(spark, d), 4, F.col("cell_id"), negative="/music/league/part_held")
    return out.select("cell_id", "relation")


def known_test_cells(spark: SparkSession, d: str) -> DataFrame:
    """[P6] Hidden cells of relations that open cells know, or of labels."""
    c = _cells(spark, d).select("cell_id", "relation", "hide")
    return C.known_cells(c.filter("hide"), c.filter("not hide"), ["REL$"]).select("cell_id", "relation", "hidden")


def informative_cells(spark: SparkSession, d: str) -> DataFrame:
    """[P7] Without tuples that teach nothing."""
    return C.remove_uninformative(_cells(spark, d).select("cell_id", "relation", "arg1", "arg2", "hide", "gold"), only_labelled=True).select("cell_id")


def whitelisted_cells(spark: SparkSession, d: str) -> DataFrame:
    """[P8] Cells of relations with at least 100 cells, of tuples that are KB relations."""
    c = _cells(spark, d)
    rels = c.groupBy("relation").count().filter("count >= 100")
    kb = table(spark, d, "kb_relations").select(F.col("sourceguid").alias("arg1"), F.col("destguid").alias("arg2"))
    return C.whitelist(c, rels, kb.distinct()).select("cell_id")


def missing_kb_tuples(spark: SparkSession, d: str) -> DataFrame:
    """[P8, U2] KB pairs without a cell."""
    kb = table(spark, d, "kb_relations").select(F.col("sourceguid").alias("arg1"), F.col("destguid").alias("arg2"))
    return C.missing_tuples(kb, _cells(spark, d))


def first_cells(spark: SparkSession, d: str) -> DataFrame:
    """[J17] The first cell of each relation and tuple."""
    return C.first_cell(_cells(spark, d).select("relation", "arg1", "arg2", "cell_id", "gold"), "cell_id")


def inserted_cells(spark: SparkSession, d: str) -> DataFrame:
    """[J17] Open cells, and hidden ones where no open cell is there."""
    c = _cells(spark, d).select("relation", "arg1", "arg2", "cell_id", "hide")
    return C.insert_absent(c.filter("not hide"), c.filter("hide")).select("cell_id")


def candidate_labels(spark: SparkSession, d: str) -> DataFrame:
    """[J18, J19] Tuples with a hidden label x labels they lack."""
    c = _cells(spark, d)
    lab = c.filter(F.col("relation").startswith("REL$"))
    return C.filled(lab.filter("hide").select("arg1", "arg2"), lab.select("relation"), c)


def cells_of_known_tuples(spark: SparkSession, d: str) -> DataFrame:
    """[J20] Hidden cells of tuples that have an open cell."""
    c = _cells(spark, d).select("cell_id", "arg1", "arg2", "hide")
    return C.add_to_known(c.filter("not hide"), c.filter("hide")).select("cell_id")


def gold_attached(spark: SparkSession, d: str) -> DataFrame:
    """[J16] 1 where the KB holds the cell."""
    kb = table(spark, d, "kb_relations").select(F.concat(F.lit("REL$"), "reltype").alias("relation"), F.col("sourceguid").alias("arg1"), F.col("destguid").alias("arg2"))
    return C.gold_values(_cells(spark, d).filter(F.col("relation").startswith("REL$")), kb).select("cell_id", "value")


def duplicated_rows(spark: SparkSession, d: str) -> DataFrame:
    """[J26, P17] Rows doubled for negatives."""
    c = _cells(spark, d).filter("arg2 is not null")
    neg = c.filter((F.col("gold") == 0.0) & F.col("relation").startswith("REL$")).select("relation", "arg1", "arg2").distinct()
    return C.duplicated_rows(c.filter("gold = 1.0").select("relation", "arg1", "arg2").distinct(), neg)


def hidden_label_overlap(spark: SparkSession, d: str) -> DataFrame:
    """[S10] Tuples with label cells."""
    return C.label_overlap(_cells(spark, d))


def unary_known(spark: SparkSession, d: str) -> DataFrame:
    """[S11] Unary cells of entities that binary cells know."""
    return C.unary_of_known(_cells(spark, d)).select("cell_id")


def entity_cells(spark: SparkSession, d: str) -> DataFrame:
    """[P16] Cells of one entity, and those left when the hidden ones are removed."""
    c = C.lookup(_cells(spark, d), entity="/m/0vv9v81")
    return C.without(c, c.filter("hide")).select("cell_id", "relation")


def pseudo_features(spark: SparkSession, d: str) -> DataFrame:
    """[M12] How often each relation is a feature of another."""
    c = C.frequency_filter(_cells(spark, d).select("relation", "arg1", "arg2", "hide"), 10, 2, PREDICT)
    return C.pseudo_features(c).groupBy("relation", "feature").agg(F.count(F.lit(1)).alias("n"))


def ordered_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """[A10] Ordered pairs of relations of a tuple."""
    return supervision.cooccurrence(_cells(spark, d).filter("arg2 is not null"), "cell_id")


def correlated_relations(spark: SparkSession, d: str) -> DataFrame:
    """[A11, A12] Relations together in at least 3 tuples."""
    return supervision.correlated_features(supervision.symmetric_cooccurrence(_cells(spark, d)), 3)


def feature_universe(spark: SparkSession, d: str) -> DataFrame:
    """[A13] Possible feature pairs of frequent relations and labels."""
    c = _cells(spark, d)
    often = c.groupBy("relation").count().filter("count >= 20")
    return supervision.feature_universe(often, c.filter(F.col("relation").startswith("REL$")))


def negative_cells(spark: SparkSession, d: str) -> DataFrame:
    """[R3, R4] Drawn negatives of each binary tuple."""
    c = _cells(spark, d).filter("arg2 is not null")
    from ..operators.counts import dictionary

    rels = dictionary(c.filter(F.col("relation").startswith("REL$")), "relation").select(F.col("relation").alias("rel"), F.col("id").alias("idx"))
    no = F.conv(F.substring(F.md5(F.concat_ws("|", "arg1", "arg2")), 1, 7), 16, 10).cast("long")
    return sampling.negatives(c.select("relation", "arg1", "arg2"), rels, 3, no)


QUERIES = {f.__name__: f for f in (
    cells_frequency_filter, relation_roles, cell_roles, negative_label_sample, known_test_cells, informative_cells, whitelisted_cells, missing_kb_tuples, first_cells, inserted_cells,
    candidate_labels, cells_of_known_tuples, gold_attached, duplicated_rows, hidden_label_overlap, unary_known, entity_cells, pseudo_features, ordered_cooccurrence,
    correlated_relations, feature_universe, negative_cells,
)}

_NS = "(starts_with(relation, 'path#') OR starts_with(relation, 'REL$'))"
_SAME = "x.arg1 IS NOT DISTINCT FROM y.arg1 AND x.arg2 IS NOT DISTINCT FROM y.arg2"
_FREQ = f"""WITH r AS (SELECT relation, count(*) n_rel FROM cells GROUP BY 1 HAVING count(*) >= 10), k AS (SELECT cells.*, n_rel FROM cells JOIN r USING (relation)),
    f AS (SELECT *, count(*) FILTER ({_NS} AND relation <> 'REL$NA') OVER (PARTITION BY arg1, arg2) n_tuple FROM k QUALIFY n_tuple >= 2 AND n_tuple < 50)"""

ORACLE = {
    "cells_frequency_filter": f"{_FREQ} SELECT cell_id, relation, arg1, arg2, n_rel, n_tuple FROM f",
    "relation_roles": r"""SELECT regexp_extract(relation, '^([A-Za-z]+[#$])', 1) ns, CASE WHEN starts_with(relation, 'unary#') THEN 'skipped' WHEN starts_with(relation, 'ner#') THEN 'feature'
        WHEN starts_with(relation, 'REL$') THEN 'label' ELSE 'pattern' END "role", count(*) n FROM cells GROUP BY 1, 2""",
    "cell_roles": "SELECT NOT coalesce(hide, false) AND coalesce(to_predict, false) training, coalesce(hide, false) AND NOT coalesce(to_predict, false) unlabeled, coalesce(hide, false) AND gold <> 0.5 test, count(*) n FROM cells GROUP BY ALL",
    "negative_label_sample": """SELECT cell_id, relation FROM (SELECT cell_id, relation, bool_or(relation = 'REL$/music/league/part_held') OVER (PARTITION BY arg1, arg2) na FROM cells)
        WHERE NOT (na AND cell_id % 4 <> 0 AND starts_with(relation, 'REL$'))""",
    "known_test_cells": """SELECT cell_id, relation, starts_with(relation, 'REL$') hidden FROM cells WHERE hide AND (starts_with(relation, 'REL$') OR relation IN (SELECT relation FROM cells WHERE NOT hide))""",
    "informative_cells": """SELECT cell_id FROM cells QUALIFY (count(*) FILTER (NOT coalesce(hide, false)) OVER w > 1 OR bool_or(coalesce(hide, false)) OVER w)
        AND bool_or(starts_with(relation, 'REL$') AND gold > 0.5) OVER w""".replace("QUALIFY", "WINDOW w AS (PARTITION BY arg1, arg2) QUALIFY"),
    "whitelisted_cells": """SELECT cell_id FROM cells WHERE relation IN (SELECT relation FROM cells GROUP BY 1 HAVING count(*) >= 100) AND (arg1, arg2) IN (SELECT (sourceguid, destguid) FROM kb_relations)""",
    "missing_kb_tuples": "SELECT DISTINCT sourceguid arg1, destguid arg2 FROM kb_relations EXCEPT SELECT arg1, arg2 FROM cells",
    "first_cells": "SELECT relation, arg1, arg2, min(cell_id) cell_id, arg_min(gold, cell_id) gold FROM cells GROUP BY 1, 2, 3",
    "inserted_cells": f"""SELECT cell_id FROM cells WHERE NOT hide UNION ALL
        SELECT cell_id FROM cells x WHERE hide AND NOT EXISTS (SELECT 1 FROM cells y WHERE NOT y.hide AND x.relation = y.relation AND {_SAME})""",
    "candidate_labels": f"""WITH t AS (SELECT DISTINCT arg1, arg2 FROM cells WHERE hide AND starts_with(relation, 'REL$')), l AS (SELECT DISTINCT relation FROM cells WHERE starts_with(relation, 'REL$'))
        SELECT arg1, arg2, relation, 0.0::DOUBLE target FROM t x, l WHERE NOT EXISTS (SELECT 1 FROM cells y WHERE y.relation = l.relation AND {_SAME})""",
    "cells_of_known_tuples": f"SELECT cell_id FROM cells x WHERE hide AND EXISTS (SELECT 1 FROM cells y WHERE NOT y.hide AND {_SAME})",
    "gold_attached": """SELECT cell_id, CASE WHEN g.relation IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE "value" FROM cells c
        LEFT JOIN (SELECT DISTINCT 'REL$' || reltype relation, sourceguid arg1, destguid arg2 FROM kb_relations) g USING (relation, arg1, arg2) WHERE starts_with(c.relation, 'REL$')""",
    "duplicated_rows": """WITH p AS (SELECT DISTINCT relation, arg1, arg2 FROM cells WHERE gold = 1 AND arg2 IS NOT NULL),
        n AS (SELECT DISTINCT relation, arg1, arg2 FROM cells WHERE gold = 0 AND arg2 IS NOT NULL AND starts_with(relation, 'REL$'))
        SELECT DISTINCT p.relation, p.arg1 || ' [' || n.relation || ']' arg1, arg2, 1.0::DOUBLE target, true is_dup FROM p JOIN n USING (arg1, arg2)
        UNION SELECT relation, arg1 || ' [' || relation || ']', arg2, 0.0, true FROM n WHERE (arg1, arg2) IN (SELECT (arg1, arg2) FROM p)""",
    "hidden_label_overlap": "SELECT arg1, arg2, count(*) FILTER (starts_with(relation, 'REL$')) n_labels, count(*) FILTER (NOT starts_with(relation, 'REL$')) n_open FROM cells GROUP BY 1, 2 HAVING n_labels > 0",
    "unary_known": "SELECT cell_id FROM cells WHERE arg2 IS NULL AND arg1 IN (SELECT arg1 FROM cells WHERE arg2 IS NOT NULL UNION SELECT arg2 FROM cells WHERE arg2 IS NOT NULL)",
    "entity_cells": f"""WITH e AS (SELECT * FROM cells WHERE arg1 = '/m/0vv9v81' OR arg2 = '/m/0vv9v81')
        SELECT cell_id, relation FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.hide AND x.relation = y.relation AND {_SAME})""",
    "pseudo_features": f"""{_FREQ}, t AS (SELECT DISTINCT relation, arg1, arg2 FROM f WHERE NOT coalesce(hide, false))
        SELECT x.relation, y.relation feature, count(*) n FROM t x JOIN t y ON {_SAME} WHERE x.relation <> y.relation AND NOT starts_with(y.relation, 'REL$') GROUP BY 1, 2""",
    "ordered_cooccurrence": "SELECT x.relation rel_i, y.relation rel_j, count(*) n FROM cells x JOIN cells y ON x.arg1 = y.arg1 AND x.arg2 = y.arg2 AND x.cell_id < y.cell_id GROUP BY 1, 2",
    "correlated_relations": f"""WITH t AS (SELECT DISTINCT relation, arg1, arg2 FROM cells) SELECT x.relation, y.relation other, count(*) n FROM t x JOIN t y ON {_SAME} AND x.relation <> y.relation GROUP BY 1, 2 HAVING count(*) >= 3""",
    "feature_universe": """SELECT f.relation feature, t.relation target FROM (SELECT relation FROM cells GROUP BY 1 HAVING count(*) >= 20) f, (SELECT DISTINCT relation FROM cells WHERE starts_with(relation, 'REL$')) t
        WHERE f.relation <> t.relation""",
    "negative_cells": """WITH c AS (SELECT DISTINCT relation, arg1, arg2 FROM cells WHERE arg2 IS NOT NULL), r AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 idx FROM (SELECT DISTINCT relation FROM c WHERE starts_with(relation, 'REL$'))),
        t AS (SELECT DISTINCT arg1, arg2, ('0x' || substr(md5(arg1 || '|' || arg2), 1, 7))::BIGINT t FROM c), d AS (SELECT DISTINCT arg1, arg2, (t * 7919 + i * 104729) % (SELECT count(*) FROM r) idx FROM t, range(3) g(i))
        SELECT arg1, arg2, relation, 0.0::DOUBLE target FROM d JOIN r USING (idx) ANTI JOIN c USING (relation, arg1, arg2)""",
}
