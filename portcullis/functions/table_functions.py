"""The rule matcher as a table function, for SQL: SELECT * FROM files, LATERAL match_rules(content, language)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from portcullis.rules import Rule


def register(spark: SparkSession, rules: list[Rule], name: str = "match_rules") -> None:
    given = tuple(rules)

    @udtf(returnType="rule_id string, line_start bigint, line_end bigint, code_snippet string, captures map<string,string>")
    class MatchRules:
        def eval(self, content: str, language: str):
            from portcullis.operators.scan import _matcher

            for piece in _matcher(given).pieces(content or "", language):
                for m in piece:
                    yield m["rule_id"], m["line_start"], m["line_end"], m["code_snippet"], dict(m["captures"])

    spark.udtf.register(name, MatchRules)
