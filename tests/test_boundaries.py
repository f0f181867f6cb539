"""Stream queries against their SQL where every fraction of the even clients lies on the ramp that it is held against."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators.folds import fold
from tidewatch.sources.streams import rounded

from .test_queries import plain

QUERIES, ORACLES = entry.catalog()


def differences(spark, folder, table, name):
    """Rows that only the query gives, and rows that only its SQL gives, over a folder's one table."""
    df = QUERIES[name](spark, str(folder))
    got = [tuple(plain(x) for x in r) for r in df.collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = [tuple(plain(x) for x in r) for r in con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()]
    assert len(got) == len(want) > 0
    return set(got) - set(want), set(want) - set(got)


@pytest.fixture(scope="module")
def on_ramp(tmp_path_factory):
    """Ten clients of 200 rows; the even ones change every 40 rows, and a row ``s`` behind has 0.2 + 0.03 s (0.9 at most) of 200."""
    ids = pd.Series(range(2000))
    since = ids // 10 % 40
    events = pd.DataFrame({
        "event_id": ids, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(ids, unit="min"), "user_id": ids % 10, "event_type": "view",
        "value": (2 * (20 + 3 * since).clip(upper=90)).astype(float), "props": "{}",
    })
    folder = tmp_path_factory.mktemp("ramp")
    duckdb.from_df(events).select("* REPLACE (CAST(ts AS TIMESTAMP) AS ts)").write_parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["src_10_stream", "agg_14_recovery_curve", "agg_19_selections", "exp_6_meta_gains", "exp_6_meta_router", "jn_12_agreement", "jn_14_previous_difference", "lif_15_snapshots", "win_3_moving_average"])
def test_on_the_ramp(spark, on_ramp, name):
    assert differences(spark, on_ramp, "events", name) == (set(), set())


def write_events(folder, **columns):
    """A table of events; unnamed columns count up."""
    ids = pd.Series(range(len(next(iter(columns.values())))))
    events = pd.DataFrame({"event_id": ids, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(ids, unit="h"), "user_id": ids % 10, "event_type": "view", "value": ids * 0.07, "props": "{}"} | columns)
    duckdb.from_df(events).select("* REPLACE (CAST(ts AS TIMESTAMP) AS ts, CAST(event_id AS BIGINT) AS event_id)").write_parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Users below 0; every ninth row has no time, and one of those no id either."""
    ids = pd.Series(range(2000))
    ts = (pd.Timestamp("2024-01-01") + pd.to_timedelta(ids * 7919 % 2000, unit="h")).where(ids % 9 > 0)
    return write_events(tmp_path_factory.mktemp("odd"), event_id=ids.astype("Int64").where(ids != 9), ts=ts, user_id=5 - ids * 31 % 20, value=(ids * 617 % 2000) / 10)


@pytest.mark.parametrize("name", ["agg_14_recovery_curve", "agg_19_selections", "exp_6_meta_gains", "exp_6_meta_router", "jn_12_agreement", "jn_14_previous_difference", "lif_15_snapshots", "win_3_moving_average"])
def test_odd_keys(spark, odd, name):
    assert differences(spark, odd, "events", name) == (set(), set())


@pytest.fixture(scope="module")
def keyless(tmp_path_factory):
    """Every eleventh event has no user."""
    ids = pd.Series(range(2000))
    kinds = pd.Series(["view", "error", "click"])[ids * 7919 % 3].reset_index(drop=True)
    return write_events(tmp_path_factory.mktemp("keyless"), user_id=(ids * 31 % 20).astype("Int64").where(ids % 11 > 0), event_type=kinds, value=(ids * 617 % 2000) / 10)


@pytest.mark.parametrize("name", ["epi_1_episodes", "exp_1_adahedge", "exp_6_meta_gains", "exp_8_recalibration", "jn_12_agreement", "jn_14_previous_difference", "lif_4_handshakes", "lif_15_snapshots", "met_detection", "met_detection_profile", "met_resource_profile", "res_2_suppressed_alarms", "src_10_stream", "src_11_random_schedule", "win_2_runs", "win_3_moving_average"])
def test_events_without_a_user(spark, keyless, name):
    assert differences(spark, keyless, "events", name) == (set(), set())


@pytest.mark.parametrize("name", ["exp_1_adahedge", "exp_3_fixed_share", "exp_6_meta_gains", "exp_6_meta_router", "exp_8_replay_in_stream"])
def test_losses_below_zero(spark, tmp_path, name):
    """Every seventh value is below 0."""
    ids = pd.Series(range(2000))
    value = (ids * 617 % 2000) / 10
    assert differences(spark, write_events(tmp_path, value=value.where(ids % 7 > 0, -value)), "events", name) == (set(), set())


@pytest.mark.parametrize("name", ["jn_14_previous_difference", "src_10_stream"])
def test_one_order_of_ties(spark, tmp_path_factory, name):
    """Events of one id at ten times, stored in two orders, and with ids in the order that the stream gives to ties."""
    ids = pd.Series(range(2000))
    kinds = pd.Series(["view", "error", "click"])[ids * 7919 % 3].reset_index(drop=True)
    tied = pd.DataFrame({"event_id": ids * 0, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(ids // 200 * 5, unit="h"), "user_id": ids * 31 % 20, "event_type": kinds, "value": (ids * 617 % 2000) / 10})
    numbered = tied.sort_values(["ts", "event_type", "value"], ignore_index=True).assign(event_id=ids)
    folders = [write_events(tmp_path_factory.mktemp("ties"), **t) for t in (numbered, tied, tied[::-1].reset_index(drop=True))]
    assert differences(spark, folders[0], "events", name) == (set(), set())
    want, *got = [sorted(map(tuple, QUERIES[name](spark, str(f)).collect()), key=str) for f in folders]
    assert got == [want, want]


def test_models_of_clients_with_a_user(spark, keyless):
    assert sorted(r.client for r in QUERIES["ml_1_client_models"](spark, str(keyless)).collect()) == list(range(10))


def test_one_state_for_rows_without_a_key(spark):
    """Numbers that were counted so far, of keys 1 and null."""

    def start():
        seen = []
        return lambda at: seen.append(at) or (int(at), len(seen))

    rows = spark.createDataFrame([(k, t) for k in (1, None) for t in range(3)], "k long, t long")
    got = fold(rows, ["k"], ["t"], start, ["t"], "t long, n long").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(k, t, t + 1) for k in (1, None) for t in range(3)], key=str)


def test_no_average_of_short_clients(spark, tmp_path):
    """Client 3 has 30 rows, fewer than a window."""
    ids = pd.Series(range(1000))
    users = (ids % 10).replace(3, 4).where(ids >= 30, 3)
    assert differences(spark, write_events(tmp_path, user_id=users), "events", "win_3_moving_average") == (set(), set())


def test_ties_round_as_in_sql(spark):
    """Halves of a millionth: 369 of 5760 lies below one where it is multiplied, not as a decimal."""
    values = [c / 5760 for c in range(0, 5761, 9)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"))).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(v, 6) FROM unnest(?::DOUBLE[]) AS t(v)", [values]).fetchall()]


def test_features_just_below_zero(spark, tmp_path):
    """Orders whose ring samples round to zero from below (-0.0000), and some from above."""
    keys = pd.DataFrame({"o_orderkey": [147791, 271131, 1009987, 1380659, *range(1000)]})
    duckdb.from_df(keys).write_parquet(f"{tmp_path}/orders.parquet")
    assert differences(spark, tmp_path, "orders", "src_1_blob_samples") == (set(), set())
