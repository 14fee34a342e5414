"""Load delimited records while setting aside, with a reason, those that break the schema.

From a schema an anchored regular expression for whole rows is generated. Rows that match
are loaded; the others pass through patterns for ever longer field prefixes, and the first
that fails names the broken field. All of it is column expressions on the JVM, one scan,
no shuffle. The patterns use possessive repetition only, so they neither backtrack nor
recurse on very long rows.

Defined cases: a null record is ``quoting`` at field 1; an empty record is one empty field,
hence ``columns`` unless the schema has a single field; an empty table gives empty results;
rows are judged one by one, so repeats and order don't matter. Other input columns are kept;
one whose name is that of a schema field comes out as ``input_<name>``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAP = "(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
#: Exactly the days of the proleptic Gregorian calendar from year 1 to 9999, as yyyy-MM-dd.
CALENDAR_DAY = (
    "(?!0000)(?:[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)"
    f"|02-(?:0[1-9]|1[0-9]|2[0-8]))|{_LEAP}-02-29)"
)
#: Replacement character, delete, and controls other than tab, line feed and carriage return.
DAMAGE = r"\x{FFFD}\x7F\x00-\x08\x0B\x0C\x0E-\x1F"


@dataclass(frozen=True)
class FieldRule:
    """One field: its name, and either a pattern its whole value matches or characters it must not hold.

    ``value`` is for patterns without quotes, commas and line breaks; an empty value passes if
    ``optional``. ``reason`` names the failure. Fields without rule accept any value.
    """

    name: str
    value: str | None = None
    without: str | None = None
    optional: bool = True
    reason: str | None = None

    def pattern(self, plain: bool = False) -> str:
        """The field in both spellings; ``plain`` leaves out the rule."""
        if self.value and not plain:
            inner = f"(?:{self.value})" + ("?" if self.optional else "")
            return f'(?:"{inner}"|{inner})'
        bad = "" if plain or not self.without else self.without
        return f'(?:"[^"{bad}]*+(?:""[^"{bad}]*+)*+"|[^",\\r\\n{bad}]*+)'


@dataclass(frozen=True)
class RowSchema:
    """Fields in order; ``order`` lists the field reasons by precedence (default: by position)."""

    fields: tuple[FieldRule, ...]
    order: tuple[str, ...] = ()

    @property
    def ruled(self) -> list[tuple[int, FieldRule]]:
        ruled = [(k, f) for k, f in enumerate(self.fields) if f.reason]
        return sorted(ruled, key=lambda kf: self.order.index(kf[1].reason)) if self.order else ruled

    def whole(self) -> str:
        """The anchored pattern of a valid row."""
        return "\\A" + ",".join(f.pattern() for f in self.fields) + "\\z"

    def readable(self) -> str:
        """Any number of well-quoted fields."""
        any_field = FieldRule("").pattern()
        return f"\\A{any_field}(?:,{any_field})*+\\z"

    def counted(self) -> str:
        return "\\A" + ",".join(f.pattern(plain=True) for f in self.fields) + "\\z"

    def prefix(self, k: int, only_last: bool = False) -> str:
        """The first ``k`` fields (of these, the rule of the last alone if ``only_last``)."""
        parts = [f.pattern(plain=only_last and i < k - 1) for i, f in enumerate(self.fields[:k])]
        return "\\A" + ",".join(parts) + "(?=,|\\z)"


def failure_reason(raw: Column, schema: RowSchema) -> Column:
    """Null for a valid row, else ``quoting``, ``columns``, or the first field reason by precedence."""
    reason = F.when(raw.isNull(), "quoting").when(raw.rlike(schema.whole()), F.lit(None).cast("string"))
    reason = reason.when(~raw.rlike(schema.readable()), "quoting").when(~raw.rlike(schema.counted()), "columns")
    for k, field in schema.ruled:
        reason = reason.when(~raw.rlike(schema.prefix(k + 1, only_last=True)), field.reason)
    return reason


def broken_field(raw: Column, schema: RowSchema) -> Column:
    """Position (from 1) of the first field that no prefix pattern reaches; one more than the
    schema has if only surplus follows."""
    place = F.when(raw.isNull(), 1)
    for k in range(1, len(schema.fields) + 1):
        place = place.when(~raw.rlike(schema.prefix(k)), k)
    return place.otherwise(len(schema.fields) + 1)


def _unquoted(value: Column) -> Column:
    inner = F.when(value.startswith('"'), F.replace(F.substr(value, F.lit(2), F.length(value) - 2), F.lit('""'), F.lit('"')))
    return F.nullif(inner.otherwise(value), F.lit(""))


def _others(df: DataFrame, raw: str, names: set[str]) -> list[Column]:
    return [F.col(f"`{c}`").alias(f"input_{c}" if c in names else c) for c in df.columns if c != raw]


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def valid_rows(df: DataFrame, raw: str, schema: RowSchema) -> DataFrame:
    """The valid records as one string column a field (empty values are null), beside the other columns."""
    names = {f.name for f in schema.fields}
    # one pass finds all fields: each follows a comma, one being put before the first
    held = _free(df, "__fields")
    each = "\\G,(" + FieldRule("").pattern() + ")"
    found = F.regexp_extract_all(F.concat(F.lit(","), F.col(raw)), F.lit(each), F.lit(1))
    kept = df.filter(F.col(raw).rlike(schema.whole())).select("*", found.alias(held))
    fields = [_unquoted(F.get(held, F.lit(k))).alias(f.name) for k, f in enumerate(schema.fields)]
    return kept.select(*_others(df, raw, names), *fields)


def rejected_rows(df: DataFrame, raw: str, schema: RowSchema) -> DataFrame:
    """The other records with ``reason`` and ``broken_field``."""
    names, why = {"reason", "broken_field"}, _free(df, "__why")
    return (
        df.withColumn(why, failure_reason(F.col(raw), schema))
        .filter(F.col(why).isNotNull())
        .select(*_others(df, raw, names), F.col(raw), F.col(why).alias("reason"), broken_field(F.col(raw), schema).alias("broken_field"))
    )


ARTICLE_ROW = RowSchema(
    (
        FieldRule("title"),
        FieldRule("text", without=DAMAGE, reason="text"),
        FieldRule("date", value=CALENDAR_DAY, reason="date"),
        FieldRule("category"),
        FieldRule("subcategory"),
        FieldRule("link"),
    ),
    order=("date", "text"),
)
