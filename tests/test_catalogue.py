"""Catalogue queries against their oracle on a small generated database."""

import datetime
import random

import duckdb
import pandas as pd
import pytest

from brindle.plans import catalogue


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(1)
    path = tmp_path_factory.mktemp("tables")
    day = lambda: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=rng.randrange(2400))
    money = lambda: rng.randrange(100, 40_000_000) / 100
    int32 = {"r_regionkey", "n_nationkey", "n_regionkey", "c_nationkey", "s_nationkey", "p_size", "l_linenumber"}
    tables = {
        "region": [{"r_regionkey": i, "r_name": f"R{i}"} for i in range(5)],
        "nation": [{"n_nationkey": i, "n_name": f"NATION_{i}", "n_regionkey": i % 5} for i in range(25)],
        "customer": [{"c_custkey": i, "c_name": f"Customer#{i}", "c_nationkey": rng.randrange(25), "c_acctbal": money() / 100 - 500, "c_mktsegment": rng.choice("AB")} for i in range(60)],
        "supplier": [{"s_suppkey": i, "s_name": f"S{i}", "s_nationkey": rng.randrange(25), "s_acctbal": rng.randrange(9000) / 1.0} for i in range(20)],
        "part": [{"p_partkey": i, "p_name": rng.choice(["cold widget", "hot bolt", "tool"]), "p_brand": "Brand#1" + rng.choice("12"), "p_type": rng.choice("xyz"), "p_size": rng.randrange(50), "p_retailprice": money()} for i in range(50)],
        "orders": [{"o_orderkey": i, "o_custkey": rng.randrange(50), "o_orderstatus": rng.choice("FOP"), "o_totalprice": money(), "o_orderdate": day(), "o_orderpriority": rng.choice(["1-URGENT", "5-LOW", "3-MEDIUM"])} for i in range(300)],
        "lineitem": [{"l_orderkey": rng.randrange(310), "l_partkey": rng.randrange(50), "l_suppkey": rng.randrange(20), "l_linenumber": rng.randrange(1, 7), "l_quantity": float(rng.randrange(1, 50)), "l_extendedprice": money(), "l_discount": 0.05, "l_tax": rng.randrange(8) / 100, "l_returnflag": rng.choice("ANR"), "l_linestatus": rng.choice("OF"), "l_shipdate": day()} for _ in range(900)],
        "events": [{"event_id": i, "ts": day(), "user_id": rng.randrange(20), "event_type": rng.choice(["click", "view", "buy"]), "value": 1.5, "props": f'{{"k": {i % 7}}}'} for i in range(200)],
    }
    for name, rows in tables.items():
        df = pd.DataFrame(rows)
        for c in df.columns:
            if c in int32:
                df[c] = df[c].astype("int32")
            elif str(df[c].dtype).startswith("datetime"):
                df[c] = df[c].astype("datetime64[us]")
        df.to_parquet(f"{path}/{name}.parquet")
    return str(path)


SAMPLE = [
    "flagship", "s2_eq_lookup", "s4_values", "p8_div", "p9_like", "p12_is_null", "p14_not_in", "p15_exists_corr", "p16_any_gt", "p16_any_eq", "p17_all_ne", "p17_all_le",
    "p18_scalar_select", "p19_correlated", "p21_cast_text", "p21_cast_bool", "j2_left", "j4_full", "j6_theta", "a2_count_null", "a8_null_group", "a11_global_empty", "a12_having",
    "o1_null_order", "o4_offset", "o5_distinct_on", "u4_except", "u5_intersect_all", "u6_order_before", "c1_chained", "c2_recursive_all", "c3_recursive_union", "f5_substring", "f11_date_part",
    "d5_do_nothing", "d6_do_update", "d8_update_from", "d10_delete_using", "d12_returning", "l9_on_delete", "l10_on_update", "k24_rollback", "k8_lpush", "k11_rpop", "k14_sadd", "k15_srem",
    "u7_chained", "u7_chained_first", "d1_insert_many", "d8_update_ties", "l2_primary_key", "l5_check", "l8_foreign_key_insert", "l11_drop_table", "l17_drop_and_add", "l23_create_index", "p23_unknown_column",
    "k4_keys", "k6_json_documents", "k26_isolation", "s8_s9_reopened", "s11_client", *catalogue.SCRIPTS,
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_and_oracle_agree(spark, folder, name):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalogue.queries()[name](spark, folder)
    found = con.sql(catalogue.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(found.columns)
    shown = lambda rows, names: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[names.index(c)] for c in order)]) for r in rows)
    assert shown(df.collect(), df.columns) == shown(found.fetchall(), found.columns)


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
