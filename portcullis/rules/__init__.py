"""Pattern rules: the built-in ones, those of TOML files, and their order of precedence."""

from portcullis.rules.spec import Rule, RuleError, load, load_directory, merge, parse_rule

__all__ = ["Rule", "RuleError", "builtin", "load", "load_directory", "merge", "parse_rule"]


def builtin() -> list[Rule]:
    from portcullis.rules.catalogue import RULES

    return list(RULES)
