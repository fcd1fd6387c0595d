"""Ontology matching as Column expressions: families, models, system versions, components, features and canonical names."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T

# Formats that texts are searched for.
PLATFORMS = ("iOS", "iPadOS", "watchOS", "macOS", "tvOS", "visionOS", "audioOS")
VERSION = r"\b(iOS|iPadOS|watchOS|macOS|tvOS|visionOS|audioOS)\s+(?:[A-Z][a-z]+(?:\s[A-Z][a-z]+)?\s+)?(\d{1,2}(?:\.\d{1,2}){0,2})\b"
ERROR_CODE = r"(?i)(?:error\s*(?:code)?\s*)?(-?\d{1,6})"
#: How many mentions of a kind a question may have.
CAPS = {"products": 4, "symptoms": 3, "components": 3, "features": 3, "error_codes": 2, "os_versions": 3}
#: What an extracted relation may join: head labels, tail labels.
ALLOWED = {
    "RUNS": (("Product",), ("OSVersion",)),
    "DEPENDS_ON": (("Product",), ("Product",)),
    "HAS_COMPONENT": (("Product",), ("Component",)),
    "EXHIBITS": (("Product",), ("Symptom",)),
    "INVOLVES": (("Symptom",), ("Component", "Feature")),
    "CAUSED_BY": (("Symptom",), ("Cause",)),
    "RESOLVED_BY": (("Symptom",), ("Fix",)),
    "ADDRESSES": (("Fix",), ("Cause",)),
    "REQUIRES": (("Fix",), ("OSVersion", "Product", "Feature")),
    "APPLIES_TO": (("Fix", "Symptom"), ("OSVersion",)),
    "SIGNALS": (("ErrorCode",), ("Symptom",)),
}

CANONICAL = "struct<label:string,text:string,family:string,platform:string,major:int,minor:int,patch:int>"


def alias_pattern(names: list[str]) -> str:
    """Any of the names as whole words in any case, the longest first."""
    return r"(?i)(?<![\w-])(?:" + "|".join(sorted({re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", n) for n in names}, key=lambda n: (-len(n), n))) + r")(?![\w-])"


def relation_allowed(rel: Column, head: Column, tail: Column) -> Column:
    every = [(rel == r) & head.isin(*h) & tail.isin(*t) for r, (h, t) in ALLOWED.items()]
    out = every[0]
    for x in every[1:]:
        out = out | x
    return F.coalesce(out, F.lit(False))


def version_parts(version: Column) -> Column:
    """struct<platform, major, minor, patch> of ``platform major[.minor[.patch]]``; missing parts are 0."""
    numbers = F.split(F.substring_index(version, " ", -1), r"\.")
    at = lambda i: F.coalesce(F.try_element_at(numbers, F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(F.substring_index(version, " ", 1).alias("platform"), at(1).alias("major"), at(2).alias("minor"), at(3).alias("patch"))


@dataclass(frozen=True)
class Ontology:
    """Dimension tables of names, small by nature; each entry is one pattern in the plan."""

    families: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    target_families: list[str] = field(default_factory=list)
    os_platforms: dict[str, str] = field(default_factory=dict)
    macos_names: dict[str, str] = field(default_factory=dict)
    dependencies: list[tuple[str, str]] = field(default_factory=list)
    components: dict[str, list[str]] = field(default_factory=dict)
    features: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ontology:
        """From a JSON file that Spark can reach."""
        return cls(**json.loads(spark.read.option("wholetext", True).text(path).first()[0]))

    @staticmethod
    def _named(text: Column, entries: dict[str, list[str]]) -> Column:
        found = [F.when(text.rlike(alias_pattern([name, *aliases])), F.lit(name)) for name, aliases in entries.items()]
        return F.array_sort(F.array_compact(F.array(*found))) if found else F.expr("cast(array() as array<string>)")

    def families_in(self, text: Column) -> Column:
        return self._named(text, {n: f.get("aliases", []) for n, f in self.families.items()})

    def components_in(self, text: Column) -> Column:
        return self._named(text, self.components)

    def features_in(self, text: Column) -> Column:
        return self._named(text, self.features)

    def products_in(self, text: Column) -> Column:
        """array<struct<family, name>> of models, white space in names single, distinct and sorted."""

        def of(family: str, pattern: str) -> Column:
            return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(family).alias("family"), F.trim(F.regexp_replace(m, r"\s+", " ")).alias("name")))

        found = [of(n, p) for n, f in self.families.items() for p in f.get("patterns", [])]
        return F.array_sort(F.array_distinct(F.concat(*found))) if found else F.expr("cast(array() as array<struct<family:string,name:string>>)")

    def os_versions_in(self, text: Column) -> Column:
        """Versions by number, a marketing name alone standing for its number; distinct, sorted by number."""
        plain = F.transform(F.regexp_extract_all(text, F.lit(VERSION), F.lit(0)), lambda m: F.concat_ws(" ", F.regexp_extract(m, VERSION, 1), F.regexp_extract(m, VERSION, 2)))
        if self.macos_names:
            names = "|".join(sorted(self.macos_names, key=lambda n: (-len(n), n)))
            number = F.create_map(*[F.lit(x) for kv in self.macos_names.items() for x in kv])
            bare = F.regexp_extract_all(text, F.lit(rf"\bmacOS\s+({names})\b(?!\s+\d)"), F.lit(1))
            plain = F.concat(plain, F.transform(bare, lambda n: F.concat(F.lit("macOS "), number[n])))
        keyed = F.array_sort(F.transform(F.array_distinct(plain), lambda v: F.struct(version_parts(v).alias("k"), v.alias("v"))))
        return F.transform(keyed, lambda x: x["v"])

    def requirement_kind(self, text: Column) -> Column:
        """OSVersion, Product or Feature."""
        version = (F.size(self.os_versions_in(text)) > 0) | F.split_part(text, F.lit(" "), F.lit(1)).isin(*(self.os_platforms or PLATFORMS))
        return F.when(version, "OSVersion").when((F.size(self.families_in(text)) > 0) & (F.size(self.features_in(text)) == 0), "Product").otherwise("Feature")

    def rule_mentions(self, text: Column) -> Column:
        """struct of arrays of what a question names, each capped."""
        models = F.transform(self.products_in(text), lambda p: p["name"])
        codes = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)error\s*(?:code)?\s*(-?\d{1,6})"), F.lit(1)), lambda c: F.concat(F.lit("error "), c))
        parts = {"products": F.when(F.size(models) > 0, models).otherwise(self.families_in(text)), "components": self.components_in(text), "features": self.features_in(text), "error_codes": codes, "os_versions": self.os_versions_in(text)}
        return F.struct(*[F.slice(c, 1, CAPS[k]).alias(k) for k, c in parts.items()])

    def canonical(self, label: Column, text: Column) -> Column:
        """CANONICAL of a mention whose label has rules; null drops it."""
        kept = T.strip_determiner(text)
        models, families, versions = self.products_in(text), self.families_in(text), self.os_versions_in(text)

        def made(text: Column, family: Column | None = None, version: Column | None = None) -> Column:
            v = version_parts(version) if version is not None else None
            part = lambda k, t: (v[k] if v is not None else F.lit(None)).cast(t).alias(k)
            return F.struct(label.alias("label"), text.alias("text"), (family if family is not None else F.lit(None)).cast("string").alias("family"), part("platform", "string"), part("major", "int"), part("minor", "int"), part("patch", "int"))

        product = F.when(F.size(models) > 0, made(models[0]["name"], models[0]["family"])).when(F.size(families) == 1, made(families[0], families[0])).when(kept != "", made(kept, F.lit("")))
        code = F.regexp_extract(text, ERROR_CODE, 1)
        longest = lambda names: F.array_sort(names, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))[0]
        named = lambda names: F.when(F.size(names) > 0, made(longest(names))).when(kept != "", made(F.lower(kept)))
        return (
            F.when(label == "Product", product).when((label == "OSVersion") & (F.size(versions) > 0), made(versions[0], version=versions[0]))
            .when((label == "ErrorCode") & (code != ""), made(F.concat(F.lit("error "), code))).when(label == "Component", named(self.components_in(text))).when(label == "Feature", named(self.features_in(text)))
        ).cast(CANONICAL)


def merge_mentions(a: Column, b: Column) -> Column:
    """The phrases of both in order, trimmed, each once, none blank."""
    return F.filter(F.array_distinct(F.transform(F.concat(a, b), lambda x: F.trim(x))), lambda s: s != "")


def relevance(title_families: Column, families: Column, targets: list[str], cue: Column, summary_hits: Column, units: Column, has_step: Column, excluded: Column) -> Column:
    """What makes an article worth having: a target family in the title 2, else 0.5; a cue 2; 0.3 for each of three hits; a fair length 1; steps 0.5. Without a target family, or excluded: 0."""
    hits = lambda a: F.size(F.array_intersect(a, F.lit(targets))) > 0
    score = F.when(hits(title_families), 2.0).otherwise(0.5) + F.when(cue, 2.0).otherwise(0.0) + 0.3 * F.least(summary_hits, F.lit(3)) + F.when(units.between(4, 200), 1.0).otherwise(0.0) + F.when(has_step, 0.5).otherwise(0.0)
    return F.when(~hits(families) | excluded, 0.0).otherwise(score)
