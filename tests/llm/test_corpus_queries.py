from vazante.llm.oracle import ORACLE_SQL
from vazante.llm.queries import QUERIES

COLUMNS = {
    "p2_found": ["field", "term", "mark"], "p3_found": ["article_id", "subject"], "p4_found": ["id_a", "id_b"], "p5_found": ["id_a", "id_b"],
    "p6_found": ["id_a", "id_b"], "p7_found": ["target_set", "category"], "p8_ids": ["doc_id", "ids"], "p9_found": ["source"], "p10_found": ["doc_id", "kind"],
}


def test_found_queries_have_their_columns(spark, folder):
    for name, columns in COLUMNS.items():
        assert QUERIES[name](spark, folder).columns == columns, name


def test_every_statement_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
