"""Rule documents (TOML) as rows: tags, accounts, brands and keyword rules, in layers."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = "rule_id string, rule_index int, keywords array<string>, priority int, exact_only boolean, path string, tags array<string>, disables array<string>"


def as_list(value) -> list[str]:
    """A text or a list of texts, trimmed, without blanks and repeats, order kept."""
    values = [value] if isinstance(value, str) else list(value or [])
    return list(dict.fromkeys(x.strip() for x in values if x.strip()))


@dataclass
class RuleBook:
    """Layers of rule documents, the later ones stronger."""

    rules: list[tuple] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    accounts: dict[str, str] = field(default_factory=dict)
    brands: list[str] = field(default_factory=list)
    layers: int = 0

    def add(self, document: str) -> RuleBook:
        """Read one document; raises ValueError for paths and ids that nothing declares."""
        data = tomllib.loads(document)
        for tag in data.get("tags", []):
            self.tags[tag["path"]] = tag.get("display") or tag["path"].rsplit("/", 1)[-1]
        self.accounts |= data.get("accounts", {})
        exact = {x.upper() for x in as_list(data.get("exact_only_keywords"))}
        step = 100 * (self.layers + 1)
        rules = [*data.get("rules", [])]
        for brand in data.get("brands", []):
            self.brands.append(brand["name"].upper())
            if as_list(brand.get("tags")):
                rules.append({"id": f"brand:{brand['name']}", "keywords": brand["name"], "tags": brand["tags"], "exact_only": True})
        for rule in rules:
            keywords = [k.upper() for k in as_list(rule.get("keywords"))]
            tags = as_list(rule.get("tags"))
            only = bool(rule.get("exact_only")) or bool(keywords) and all(k in exact for k in keywords)
            path = next((t for t in tags if t in self.accounts), None)
            at = len(self.rules)
            self.rules.append((rule.get("id") or f"rule:{at}", at, keywords, int(rule.get("priority", 0)) + step, only, path, tags, as_list(rule.get("disables"))))
        self.layers += 1
        self._validate()
        return self

    def _validate(self) -> None:
        ids = {r[0] for r in self.rules}
        wrong = sorted({f"tag {t}" for r in self.rules for t in r[6] if self.tags and t not in self.tags} | {f"rule id {d}" for r in self.rules for d in r[7] if d not in ids})
        if wrong:
            raise ValueError("undeclared: " + ", ".join(wrong))

    def rule_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rules, RULE_SCHEMA)

    def account_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.accounts.items()), "path string, account string")

    def tag_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.tags.items()), "path string, display string")
