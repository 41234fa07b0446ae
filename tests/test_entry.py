"""Driver contract: entry() runs, queries() and oracle_sql() line up."""
import __spark_entry__ as se


def test_entry_runs(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and df.columns == ["top_k", "n_hits", "acc"]
    accs = [r.acc for r in sorted(rows)]
    assert accs == sorted(accs)  # Acc@k is monotone in k


def test_oracle_keys_subset():
    assert set(se.oracle_sql()) <= set(se.queries())
    assert len(se.queries()) >= 50
