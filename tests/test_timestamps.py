import datetime as dt

import pytest

from textloom.operators import timestamps as T

CASES = [
    ("2019-03-10 02:23:00", None, "America/Chicago", "2019-03-10 08:23:00"),  # skipped: offset before the change
    ("2019-11-03 01:30:00", None, "America/Chicago", "2019-11-03 06:30:00"),  # repeated: offset before the change
    ("2020-10-25 02:30:00", None, "Europe/Berlin", "2020-10-25 00:30:00"),
    ("2020-03-29T02:56:34[Europe/Berlin]", None, None, "2020-03-29 01:56:34"),
    ("2019-09-12T10:06:40.9839389+05:45", None, None, "2019-09-12 04:21:40.983938"),
    ("2012-02-28 22:38:49,356", None, "UTC", "2012-02-28 22:38:49.356"),
    ("2011-01-21 19:25:57 EST", None, "Asia/Seoul", "2011-01-22 00:25:57"),
    ("2022-07-21 22:13:15 +02", None, None, "2022-07-21 20:13:15"),
    ("2020-08-21", None, "Asia/Seoul", "2020-08-20 15:00:00"),
    ("20140828044631", None, "UTC", "2014-08-28 04:46:31"),
    ("20120516T042230+0900", None, None, "2012-05-15 19:22:30"),
    ("D:20220207091451+09'00'", None, None, "2022-02-07 00:14:51"),
    ("D:20230216192221Z", None, None, "2023-02-16 19:22:21"),
    ("D:20220207091451", None, "UTC", "2022-02-07 09:14:51"),
    (r" {\creatim\yr2015\mo9\dy12\hr8\min35}  ", None, "UTC", "2015-09-12 08:35:00"),
    ("44067.48491898", None, "UTC", "2020-08-24 11:38:17"),
    ("1452525186", None, None, "2016-01-11 15:13:06"),
    ("1638616638917", None, None, "2021-12-04 11:17:18.917"),
    ("1681087002981959", None, None, "2023-04-10 00:36:42.981959"),
    ("132887000343276636", None, None, "2022-02-07 09:33:54.327663"),
    ("Fri, 06 May 2022 12:45:59 +0200", None, None, "2022-05-06 10:45:59"),
    ("7-May-2017 01:22:36", None, "UTC", "2017-05-07 01:22:36"),
    ("July 19, 2020 12:24:49 AM", None, "UTC", "2020-07-19 00:24:49"),
    ("30.6.2019, 07:17", None, "UTC", "2019-06-30 07:17:00"),
    ("01/02/2020 3:26 p.m.", "en_US", "UTC", "2020-01-02 15:26:00"),
    ("01/02/20 12:42 AM", "de_DE", "UTC", "2020-02-01 00:42:00"),
    ("2011년 11월 6일 오전 8:57:11", None, "UTC", "2011-11-06 08:57:11"),
    ("2011년 11월 6일 오후 12:05:01", None, "UTC", "2011-11-06 12:05:01"),
]
NONE = [None, "", "n/a", "-", "D:", "yesterday", "0000-00-00 00:00:00", "2021-02-30 10:15:00", "2019-13-04T08:00:00Z", r"{\creatim\yr0\mo0\dy0\hr0\min0}", "2020-01-01 24:00:00", "2020-01-01 10:61:00", "2020-01-01 10:10:60", "13/13/2020 10:00:00", "2020-01-01 10:00:00 XYZ", "2020-01-01T10:00:00[Mars/Base]", "July 19, 2020 13:24:49 PM", "x" * 100_000]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, l, z) for i, (t, l, z, _) in enumerate(CASES)] + [(1000 + i, t, None, "UTC") for i, t in enumerate(NONE)] + [(2000, "2020-01-01 10:00:00", None, None), (2001, "2020-01-01 10:00:00", None, "Nowhere/Land")]
    df = spark.createDataFrame(rows, "meta_id bigint, t string, locale string, source_zone string")
    return {r["meta_id"]: r for r in T.normalise_times(df, ["t"]).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_instants(frame, i):
    assert frame[i]["t_utc"] == dt.datetime.fromisoformat(CASES[i][3]), CASES[i]


def test_no_instants(frame):
    assert [frame[1000 + i]["t_utc"] for i in range(len(NONE))] == [None] * len(NONE)
    assert frame[2000]["t_utc"] is None and frame[2001]["t_utc"] is None and frame[2001]["t_form"] is None


def test_saved_before_created(spark):
    rows = [(1, "2020-01-02", "2020-01-01", None, "UTC", "x"), (1, "2020-01-02", "2020-01-01", None, "UTC", "x"), (2, "2020-01-01", "2020-01-01", None, "UTC", "x"), (3, None, "2020-01-01", None, "UTC", "x"), (4, "2020-01-02", "n/a", None, None, "x")]
    df = spark.createDataFrame(rows, "meta_id bigint, create_time string, last_saved_time string, locale string, source_zone string, create_time_utc string")
    assert [r[0] for r in T.saved_before_created(df).collect()] == [1]
    assert T.saved_before_created(df.limit(0)).count() == 0
