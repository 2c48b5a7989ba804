"""Search over speeches: predicates, paging, hit shaping."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions import dates, names, text
from rostrum.operators.order import numbered
from rostrum.sources.schema import known_topic

LATEST = ("term", "year")
#: Rows up to the end of a page that one task may sort.
SHALLOW = 10_000


def match_any_token(column: Column, query: str) -> Column:
    """Whether the text holds any of the query's tokens."""
    return F.arrays_overlap(text.tokens(column), text.tokens(F.lit(query)))


def date_range(column: Column, from_date: str | date | None, to_date: str | date | None) -> Column:
    """Inclusive; either end may be open. Text ends are dd.MM.yyyy."""
    end = lambda x: dates.parsed(F.lit(x)) if isinstance(x, str) else F.lit(x)
    parts = [column >= end(from_date)] if from_date is not None else []
    parts += [column <= end(to_date)] if to_date is not None else []
    return reduce(and_, parts, F.lit(True))


def predicate(
    query_text: str | None = None, mp_name: str | None = None, term: int | None = None, year: int | None = None, topic_id: int | None = None,
    topic_label: str | None = None, province: str | None = None, political_party: str | None = None, from_date: str | None = None, to_date: str | None = None,
) -> Column:
    """All given conditions; a topic id goes before a topic label."""
    parts = [match_any_token(F.col("content"), query_text)] if query_text else []
    exact = {"speech_giver": mp_name, "term": term, "year": year, "province": province, "political_party_at_time": political_party}
    exact |= {"topic_id": topic_id} if topic_id is not None else {"topic_label": topic_label}
    parts += [F.col(c) == v for c, v in exact.items() if v is not None]
    if from_date is not None or to_date is not None:
        parts.append(date_range(F.col("session_date"), from_date, to_date))
    return reduce(and_, parts, F.lit(True))


def search(speeches: DataFrame, size: int = 20, from_: int = 0, sort_by: str = "date", query_text: str | None = None, **filters) -> DataFrame:
    """A page of matching speeches. Relevance order holds only with a query text; ids break ties."""
    found = speeches.where(predicate(query_text=query_text, **filters))
    latest = [F.col("term").desc(), F.col("year").desc(), F.col("id")]
    if sort_by == "relevance" and query_text:
        scores = text.bm25(speeches, "id", "content", sorted(set(query_text.lower().split())))
        found = found.join(scores, "id", "left").withColumn("score", F.round("score", 6))
        latest = [F.col("score").desc_nulls_last(), F.col("id")]
    return page(found, latest, size, from_)


def page(df: DataFrame, order: list[Column], size: int, from_: int = 0) -> DataFrame:
    """Rows from_ to from_ + size in an order. Tasks keep only the rows that a shallow page may need; for a deep one, rows
    are numbered by ranges, so that no task holds all that it skips."""
    if from_ + size <= SHALLOW:
        return df.orderBy(*order).offset(from_).limit(size)
    place = F.col("__place")
    return numbered(df, order, out="__place").where(place.between(from_, from_ + size - 1)).orderBy(place).drop("__place")


def total_pages(total: Column, size: int) -> Column:
    return F.ceil(total / size)


def clamped_page(df: DataFrame, order: list[Column], page_no: int, size: int) -> DataFrame:
    """The asked page, or the nearest there is."""
    last = max(1, -(-df.count() // size))
    return page(df, order, size, (min(max(page_no, 1), last) - 1) * size)


def shaped(hits: DataFrame) -> DataFrame:
    """Party at the time, else the first listed one, without its term; served terms joined."""
    party = F.coalesce("political_party_at_time", F.try_element_at("political_party", F.lit(1)))
    return hits.withColumn("party", names.party_without_term(party)).withColumn("terms", F.array_join("terms_served", ", "))


def by_entity(nested: DataFrame, entity: str, entity_group: str | None = None) -> DataFrame:
    """Speeches that hold the entity, with that type in the same element if one is given."""
    same = lambda e: (e["entity"] == entity) & (F.lit(True) if entity_group is None else e["entity_group"] == entity_group)
    return nested.where(F.exists("ner_entities", same))


def visible(speeches: DataFrame) -> DataFrame:
    """Without sentinel topics; speeches without a topic stay."""
    return speeches.where(known_topic(F.col("topic_id")))


def with_text(speeches: DataFrame) -> DataFrame:
    return speeches.where(F.length(F.trim("content")) > 0)


def served_since(members: DataFrame, term: int = 17) -> DataFrame:
    return members.where(F.array_max("terms") >= term)
