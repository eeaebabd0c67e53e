"""Column functions on text, relations and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of Unicode, and the signs that cleaning deletes.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DELETED = "\u0000\uf0b7\u2022"

#: Canonical verbs and the forms that mean them.
RELATIONS = {
    "uses": ["uses", "utilizes", "employs", "applies", "use"],
    "implements": ["implements", "implement"],
    "improves": ["improves", "enhances", "improve", "enhance"],
    "extends": ["extends", "extend"],
    "contains": ["contains", "contain", "includes", "include"],
    "consists_of": ["consists_of", "consist"],
    "based_on": ["based_on", "base"],
    "is_a": ["is_a", "type_of"],
    "depends_on": ["relies_on", "depends_on", "depend", "rely"],
}


def clean_text(text: Column) -> Column:
    """White space becomes single spaces and the ends are trimmed; then bullets and nulls are deleted."""
    spaced = F.translate(text, WHITE, " " * len(WHITE))
    return F.translate(F.trim(F.regexp_replace(spaced, "  +", " ")), DELETED, "")


def chunks(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Overlapping pieces; the last is the first that reaches the text's end."""
    if overlap >= size:
        raise ValueError("overlap must be less than the size")
    step = size - overlap
    n = F.when(F.length(text) == 0, 0).when(F.length(text) <= size, 1).otherwise(F.ceil((F.length(text) - size) / step) + 1).cast("int")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: k < n)
    return F.transform(starts, lambda k: text.substr(k * step + 1, F.lit(size)))


def normalize_relation(relation: Column) -> Column:
    """Lower case, then the canonical verb; unknown relations stay."""
    low = F.lower(relation)
    out = low
    for verb, forms in RELATIONS.items():
        out = F.when(low.isin(forms), F.lit(verb)).otherwise(out)
    return out


def role(importance: Column) -> Column:
    return F.when(importance > 0.7, "core").when(importance > 0.4, "supporting").otherwise("peripheral")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


# ------------------------------------------------------------------------------------ templates


def _or_empty(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(""))


def node_text(name: Column, kind: Column, description: Column, labelled: bool = True) -> Column:
    """What is embedded for a node; the evaluation's form has no label before the type."""
    return F.concat(_or_empty(name), F.lit(". Type: " if labelled else ". "), _or_empty(kind), F.lit(". "), _or_empty(description))


def topic_text(name: Column, entities: Column, first: int = 5) -> Column:
    """What is embedded for a topic when noise is rescued: its name and first entities."""
    return F.concat(_or_empty(name), F.lit(". "), F.array_join(F.slice(F.coalesce(entities, F.array()), 1, first), ", "))


def leaf_text(name: Column, entities: Column, keywords: Column, description: Column) -> Column:
    """What is embedded for a tree's leaf: the parts that are not empty, joined by full stops."""
    listed = lambda head, xs, k: F.when(F.size(F.coalesce(xs, F.array())) > 0, F.concat(F.lit(head), F.array_join(F.slice(xs, 1, k), ", ")))
    return F.concat_ws(". ", F.nullif(name, F.lit("")), listed("Key concepts: ", entities, 10), listed("Types: ", keywords, 5), F.nullif(description, F.lit("")))


def topic_description(entities: Column) -> Column:
    """The sentence that describes a topic by its three first entities, and how many of five are left."""
    k = F.least(F.size(entities), F.lit(5))
    more = F.when(k > 3, F.concat(F.lit(" and "), (k - 3).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.lit("Cluster of related concepts including "), F.array_join(F.slice(entities, 1, 3), ", "), more)


def preview(text: Column, size: int = 200, always: bool = False) -> Column:
    """The first signs; dots follow if something was cut, or always."""
    dots = F.lit("...") if always else F.when(F.length(text) > size, "...").otherwise("")
    return F.concat(F.substring(text, 1, size), dots)


def first_distinct(items: Column, most: int) -> Column:
    return F.slice(F.array_distinct(items), 1, most)


# -------------------------------------------------------------------------------------- replies


def name_numbers(reply: Column) -> Column:
    """``name:int, name:int`` as an array of (name, number); what has no whole number is skipped."""
    parts = F.transform(F.split(reply, ","), lambda p: F.struct(F.trim(F.regexp_extract(p, r"(?s)^(.*):[^:]*$", 1)).alias("name"), F.trim(F.regexp_extract(p, r"(?s)^.*:([^:]*)$", 1)).try_cast("int").alias("number")))
    return F.filter(parts, lambda x: x["number"].isNotNull())


def type_lines(reply: Column) -> Column:
    """Lines ``type|confidence`` as an array of (type, confidence), 0.7 where there is no number."""
    def one(line: Column) -> Column:
        cells = F.split(F.trim(line), r"\|")
        return F.struct(F.lower(F.trim(F.get(cells, F.lit(0)))).alias("type"), F.coalesce(F.trim(F.get(cells, F.lit(1))).try_cast("double"), F.lit(0.7)).alias("confidence"))

    return F.transform(F.split(F.trim(reply), "\n"), one)


# -------------------------------------------------------------------------------------- ratings


def rating(value: Column, excellent: float | None, good: float) -> Column:
    out = F.when(value > good, "Good").otherwise("Fair")
    return out if excellent is None else F.when(value > excellent, "Excellent").otherwise(out)


#: From where on a measure is excellent, and good.
RATINGS = {"modularity": (0.7, 0.5), "silhouette_score": (0.5, 0.25), "topic_coherence": (0.7, 0.5), "coverage": (0.9, 0.7), "avg_degree": (None, 2.0)}
