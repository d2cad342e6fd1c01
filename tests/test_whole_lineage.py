from checks import report_queries as Q


def test_lineage_queries_hold_literal_rows():
    for name in ("relationships", "graph_lineage"):
        assert Q.ORACLES[name] == Q.ORACLES[f"{name}_expanded"]
        assert Q.ORACLES[f"{name}_factored"] != Q.ORACLES[name] and f"{name}_factored" in Q.QUERIES
        assert "st_frel" not in Q.ORACLES[name]
