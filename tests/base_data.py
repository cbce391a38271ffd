"""Six subjects of an event dataset, as text: subject, time, code, value."""

from datetime import datetime

from pyspark.sql import functions as F

ROWS = """
239684,,EYE_COLOR//BROWN,
239684,,HEIGHT,175.271115221764
239684,1980-12-28 00:00:00,MEDS_BIRTH,
239684,2010-05-11 17:41:51,ADMISSION//CARDIAC,
239684,2010-05-11 17:41:51,HR,102.6
239684,2010-05-11 17:41:51,TEMP,96.0
239684,2010-05-11 17:48:48,HR,105.1
239684,2010-05-11 17:48:48,TEMP,96.2
239684,2010-05-11 18:25:35,HR,113.4
239684,2010-05-11 18:25:35,TEMP,95.8
239684,2010-05-11 18:57:18,HR,112.6
239684,2010-05-11 18:57:18,TEMP,95.5
239684,2010-05-11 19:27:19,DISCHARGE,
1195293,,EYE_COLOR//BLUE,
1195293,,HEIGHT,164.6868838269085
1195293,1978-06-20 00:00:00,MEDS_BIRTH,
1195293,2010-06-20 19:23:52,ADMISSION//CARDIAC,
1195293,2010-06-20 19:23:52,HR,109.0
1195293,2010-06-20 19:23:52,TEMP,100.0
1195293,2010-06-20 19:25:32,HR,114.1
1195293,2010-06-20 19:25:32,TEMP,100.0
1195293,2010-06-20 19:45:19,HR,119.8
1195293,2010-06-20 19:45:19,TEMP,99.9
1195293,2010-06-20 20:12:31,HR,112.5
1195293,2010-06-20 20:12:31,TEMP,99.8
1195293,2010-06-20 20:24:44,HR,107.7
1195293,2010-06-20 20:24:44,TEMP,100.0
1195293,2010-06-20 20:41:33,HR,107.5
1195293,2010-06-20 20:41:33,TEMP,100.4
1195293,2010-06-20 20:50:04,DISCHARGE,
68729,,EYE_COLOR//HAZEL,
68729,,HEIGHT,160.3953106166676
68729,1978-03-09 00:00:00,MEDS_BIRTH,
68729,2010-05-26 02:30:56,ADMISSION//PULMONARY,
68729,2010-05-26 02:30:56,HR,86.0
68729,2010-05-26 02:30:56,TEMP,97.8
68729,2010-05-26 04:51:52,DISCHARGE,
814703,,EYE_COLOR//HAZEL,
814703,,HEIGHT,156.48559093209357
814703,1976-03-28 00:00:00,MEDS_BIRTH,
814703,2010-02-05 05:55:39,ADMISSION//ORTHOPEDIC,
814703,2010-02-05 05:55:39,HR,170.2
814703,2010-02-05 05:55:39,TEMP,100.1
814703,2010-02-05 07:02:30,DISCHARGE,
754281,,EYE_COLOR//BROWN,
754281,,HEIGHT,166.22261567137025
754281,1988-12-19 00:00:00,MEDS_BIRTH,
754281,2010-01-03 06:27:59,ADMISSION//PULMONARY,
754281,2010-01-03 06:27:59,HR,142.0
754281,2010-01-03 06:27:59,TEMP,99.8
754281,2010-01-03 08:22:13,DISCHARGE,
1500733,,EYE_COLOR//BROWN,
1500733,,HEIGHT,158.60131573580904
1500733,1986-07-20 00:00:00,MEDS_BIRTH,
1500733,2010-06-03 14:54:38,ADMISSION//ORTHOPEDIC,
1500733,2010-06-03 14:54:38,HR,91.4
1500733,2010-06-03 14:54:38,TEMP,100.0
1500733,2010-06-03 15:39:49,HR,84.4
1500733,2010-06-03 15:39:49,TEMP,100.3
1500733,2010-06-03 16:20:49,HR,90.1
1500733,2010-06-03 16:20:49,TEMP,100.1
1500733,2010-06-03 16:44:26,DISCHARGE,
"""
SPLITS = [(239684, "train"), (1195293, "train"), (68729, "train"), (814703, "train"), (754281, "tuning"), (1500733, "held_out")]


def parsed():
    out = []
    for line in ROWS.strip().splitlines():
        s, t, c, v = line.split(",")
        out.append((int(s), datetime.fromisoformat(t) if t else None, c, float(v) if v else None))
    return out


def events(spark, ordered=True):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(parsed())], "subject_id long, time timestamp, code string, numeric_value float, __ord long")
    return df if ordered else df.drop("__ord")


def splits(spark):
    return spark.createDataFrame(SPLITS, "subject_id long, split string")


def in_order(df, subject):
    return df.where(F.col("subject_id") == subject).orderBy(F.col("time").asc_nulls_first(), "__ord").collect()
