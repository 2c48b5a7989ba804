"""Schemas and fixed dimensions of the speech corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Topic ids that mean "outlier" and "extraction error".
SENTINELS = (-1, 1)
#: Topics that analyses leave out while search keeps them.
EXCLUDED = (3, 5)

#: Term, year in term, first and last calendar year.
CALENDAR = [
    (17, 1, 1983, 1984), (17, 2, 1984, 1985), (17, 3, 1985, 1986), (17, 4, 1986, 1987), (17, 5, 1987, 1987),
    (18, 1, 1987, 1988), (18, 2, 1988, 1989), (18, 3, 1989, 1990), (18, 4, 1990, 1991), (18, 5, 1991, 1991),
    (19, 1, 1991, 1992), (19, 2, 1992, 1993), (19, 3, 1993, 1994), (19, 4, 1994, 1995), (19, 5, 1995, 1995),
    (20, 1, 1996, 1996), (20, 2, 1996, 1997), (20, 3, 1997, 1998), (20, 4, 1998, 1999),
    (21, 1, 1999, 1999), (21, 2, 1999, 2000), (21, 3, 2000, 2001), (21, 4, 2001, 2002), (21, 5, 2002, 2002),
    (22, 1, 2002, 2003), (22, 2, 2003, 2004), (22, 3, 2004, 2005), (22, 4, 2005, 2006), (22, 5, 2006, 2007),
    (23, 1, 2007, 2007), (23, 2, 2007, 2008), (23, 3, 2008, 2009), (23, 4, 2009, 2010), (23, 5, 2010, 2011),
    (24, 1, 2011, 2011), (24, 2, 2011, 2012), (24, 3, 2012, 2013), (24, 4, 2013, 2014), (24, 5, 2014, 2015),
    (25, 1, 2015, 2015), (25, 2, 2015, 2015), (26, 1, 2015, 2016), (26, 2, 2016, 2017), (26, 3, 2017, 2018),
    (27, 1, 2018, 2018), (27, 2, 2018, 2019), (27, 3, 2019, 2020), (27, 4, 2020, 2021), (27, 5, 2021, 2022), (27, 6, 2022, 2023),
    (28, 1, 2023, 2024),
]
CALENDAR_SCHEMA = "term int, year int, year_from int, year_to int"

ENTITY = T.StructType(
    [T.StructField("entity", T.StringType()), T.StructField("entity_group", T.StringType()), T.StructField("frequency", T.IntegerType()), T.StructField("wikipedia_url", T.StringType()), T.StructField("confidence", T.FloatType())]
)
SPEECH = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "session_id")]
    + [T.StructField(n, T.IntegerType()) for n in ("term", "year", "speech_no")]
    + [T.StructField(n, T.StringType()) for n in ("province", "speech_giver")]
    + [T.StructField("political_party", T.ArrayType(T.StringType())), T.StructField("political_party_at_time", T.StringType()), T.StructField("terms_served", T.ArrayType(T.IntegerType()))]
    + [T.StructField(n, T.StringType()) for n in ("speech_title", "page_ref", "content", "file")]
    + [T.StructField("session_date", T.DateType()), T.StructField("topic_id", T.IntegerType()), T.StructField("topic_label", T.StringType()), T.StructField("topic_analyzed", T.BooleanType()), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("keywords_str", T.StringType()), T.StructField("keywords_embedding", T.ArrayType(T.FloatType())), T.StructField("ner_entities", T.ArrayType(ENTITY))]
)


def conform(df: DataFrame, schema: T.StructType = SPEECH) -> DataFrame:
    """df with exactly the schema's columns: cast where present, null where missing, the rest dropped."""
    have = set(df.columns)
    pick = lambda f: (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
    return df.select(*[pick(f) for f in schema.fields])


def known_topic(topic: Column) -> Column:
    """Neither sentinel; a missing topic passes."""
    return ~F.coalesce(topic.isin(*SENTINELS), F.lit(False))


def analysed_topic(topic: Column, excluded: tuple[int, ...] = EXCLUDED) -> Column:
    """A topic that analyses count: present, no sentinel, not excluded."""
    return topic.isNotNull() & ~topic.isin(*SENTINELS, *excluded)
