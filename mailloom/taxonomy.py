"""Tag taxonomies as tables of any number of versions, and one version as a value of the plan.

Texts of a taxonomy (its prompt, its canonical text) are templates from `fixed` and this
module; a table fills them by column functions and a value by the same templates, so both
give equal prompts and equal hashes.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields as fields_of
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailloom import fixed
from mailloom.functions.text import token_estimate

DEFAULT_FIELDS = ("subject",)
TAGS = "version STRING, pos INT, name STRING, definition STRING, subtags ARRAY<STRING>"
RULES = "version STRING, rule_pos INT, tag STRING, fields ARRAY<STRING>, keywords ARRAY<STRING>"

# Separators of the canonical text: lines, parts of a line, members of a list.
LINE, PART, MEMBER = "\x1d", "\x1f", "\x1e"


class TaxonomyError(ValueError):
    """An entry of a taxonomy file is missing or of the wrong type."""


def _texts(value: Any, default: tuple[str, ...] = ()) -> tuple[str, ...]:
    if not value:
        return default
    if isinstance(value, str) or not all(isinstance(x, str) for x in value):
        raise TaxonomyError("a list of texts is expected")
    return tuple(value)


def _text(value: Any) -> str:
    if not isinstance(value, str):
        raise TaxonomyError("a text is expected")
    return value


@dataclass(frozen=True)
class Tag:
    name: str = field(metadata={"read": _text})
    definition: str = field(metadata={"read": _text})
    subtags: tuple[str, ...] = field(default=(), metadata={"read": _texts})


@dataclass(frozen=True)
class KeywordRule:
    tag: str = field(metadata={"read": _text})
    keywords: tuple[str, ...] = field(metadata={"read": lambda v: _texts([_text(k).lower() for k in v])})
    fields: tuple[str, ...] = field(
        default=DEFAULT_FIELDS, metadata={"read": lambda v: _texts(v, DEFAULT_FIELDS)})


@dataclass(frozen=True)
class Size:
    """Estimated tokens of a prompt, and whether they are more than the budget."""

    tokens: int
    over_budget: bool


@dataclass(frozen=True)
class Taxonomy:
    """One version, inlined in plans as literals."""

    version: str
    tags: tuple[Tag, ...]
    keyword_rules: tuple[KeywordRule, ...] = ()

    @property
    def leaves(self) -> list[str]:
        return sorted(set().union(*({tag.name, *tag.subtags} for tag in self.tags)))

    @property
    def content_hash(self) -> str:
        rows = [(t.name, t.definition, MEMBER.join(t.subtags)) for t in self.tags]
        rows += [(r.tag, MEMBER.join(r.fields), MEMBER.join(r.keywords)) for r in self.keyword_rules]
        text = LINE.join([self.version, *map(PART.join, rows)])
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    def prompt(self) -> str:
        body = [fixed.TAG_LINE % (t.name, t.definition, _subtags_note(t.subtags)) for t in self.tags]
        return fixed.TAXONOMY_HEAD % self.version + "".join("\n" + line for line in body)

    def system_prompt(self) -> str:
        return fixed.PROMPT_CLASSIFY_V1.format(taxonomy=self.prompt())

    def size(self, budget: int = fixed.TAXONOMY_TOKEN_BUDGET) -> Size:
        tokens = (len(self.prompt()) + fixed.CHARS_PER_TOKEN - 1) // fixed.CHARS_PER_TOKEN
        return Size(tokens, tokens > budget)

    def tags_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.version, i, t.name, t.definition, list(t.subtags)) for i, t in enumerate(self.tags)], TAGS)

    def rules_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.version, i, r.tag, list(r.fields), list(r.keywords))
             for i, r in enumerate(self.keyword_rules)], RULES)


def _subtags_note(subtags: tuple[str, ...]) -> str:
    return fixed.SUBTAGS_NOTE % ", ".join(subtags) if subtags else ""


# --- files ---------------------------------------------------------------------------------


def _entry(kind: type, entry: Any, place: str):
    """An entry of a file as `kind`, by the reader of each of its fields; others are ignored."""
    if not isinstance(entry, dict):
        raise TaxonomyError(f"{place}: an object is expected")
    read = {}
    for f in fields_of(kind):
        try:
            if f.name in entry:
                read[f.name] = f.metadata["read"](entry[f.name])
        except (TypeError, TaxonomyError) as exc:
            raise TaxonomyError(f"{place}.{f.name}: {exc}") from exc
    try:
        return kind(**read)
    except TypeError as exc:
        raise TaxonomyError(f"{place}: {exc}") from exc


def parse_taxonomy(spec: dict) -> Taxonomy:
    """A taxonomy from the content of a file; an error names the place of a bad entry."""
    lists = {"tags": Tag, "keyword_rules": KeywordRule}
    if not isinstance(spec, dict) or not isinstance(spec.get("version"), str):
        raise TaxonomyError("version: a text is expected")
    found = {name: tuple(_entry(kind, e, f"{name}[{i}]") for i, e in enumerate(spec.get(name) or ()))
             for name, kind in lists.items()}
    if not found["tags"]:
        raise TaxonomyError("tags: at least one is expected")
    return Taxonomy(spec["version"], **found)


def _yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError as exc:
        raise ValueError("YAML taxonomies need PyYAML; use JSON instead") from exc
    return yaml.safe_load(text)


def load_taxonomy(version: str = "v1", path: str | Path | None = None) -> Taxonomy:
    """The built-in version, or a JSON / YAML file of the same shape."""
    if path is not None:
        reader = _yaml if Path(path).suffix in (".yaml", ".yml") else json.loads
        return parse_taxonomy(reader(Path(path).read_text()))
    built_in = {spec["version"]: spec for spec in (fixed.TAXONOMY_V1,)}
    if version not in built_in:
        raise ValueError(f"no built-in taxonomy {version!r}")
    return parse_taxonomy(built_in[version])


# --- tables that hold any number of versions -----------------------------------------------


def valid_leaves(tags: DataFrame) -> DataFrame:
    """(version, leaf): tag names and subtags, as a set, in one pass."""
    every = F.concat(F.array("name"), F.coalesce("subtags", F.array().cast("array<string>")))
    return tags.select("version", F.explode(every).alias("leaf")).distinct()


def _rule_fields() -> Column:
    return F.when(F.size("fields") > 0, F.col("fields")).otherwise(F.array(*map(F.lit, DEFAULT_FIELDS)))


def exploded_keywords(rules: DataFrame) -> DataFrame:
    """(version, rule_pos, tag, fields, kw_pos, keyword), keywords in lower case."""
    return rules.select(
        "version", "rule_pos", "tag", F.array_join(_rule_fields(), ",").alias("fields"),
        F.posexplode("keywords").alias("kw_pos", "keyword"),
    ).withColumn("keyword", F.lower("keyword"))


def _in_order(line: Column, pos: str, between: str) -> Column:
    """Lines of one version by position. A version is what one model prompt holds, so small."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos), line.alias("line"))))
    return F.array_join(F.transform(ordered, lambda s: s["line"]), between)


def taxonomy_prompt(tags: DataFrame) -> DataFrame:
    """(version, prompt): the head, then one line for each tag."""
    note = F.when(F.size("subtags") > 0, F.format_string(fixed.SUBTAGS_NOTE, F.array_join("subtags", ", ")))
    line = F.format_string(fixed.TAG_LINE, "name", "definition", F.coalesce(note, F.lit("")))
    return tags.groupBy("version").agg(_in_order(line, "pos", "\n").alias("body")).select(
        "version", F.concat_ws("\n", F.format_string(fixed.TAXONOMY_HEAD, "version"), "body").alias("prompt"))


def prompt_size(tags: DataFrame, budget: int = fixed.TAXONOMY_TOKEN_BUDGET) -> DataFrame:
    """(version, tokens, over_budget) of each version's prompt."""
    sized = taxonomy_prompt(tags).select("version", token_estimate(F.col("prompt")).alias("tokens"))
    return sized.withColumn("over_budget", F.col("tokens") > budget)


def taxonomy_hash(tags: DataFrame, rules: DataFrame) -> DataFrame:
    """(version, taxonomy_hash): 16 hex of the canonical text, defaults applied first."""
    members = lambda c: F.array_join(c, MEMBER)
    subtags = F.coalesce("subtags", F.array().cast("array<string>"))
    tag_line = F.concat_ws(PART, "name", "definition", members(subtags))
    rule_line = F.concat_ws(PART, "tag", members(_rule_fields()),
                            members(F.transform("keywords", lambda k: F.lower(k))))
    tag_text = tags.groupBy("version").agg(_in_order(tag_line, "pos", LINE).alias("tag_text"))
    rule_text = rules.groupBy("version").agg(_in_order(rule_line, "rule_pos", LINE).alias("rule_text"))
    text = F.concat_ws(LINE, "version", "tag_text", "rule_text")  # no rules: null, left out
    return tag_text.join(rule_text, "version", "left").select(
        "version", F.left(F.sha2(text, 256), F.lit(16)).alias("taxonomy_hash"))
