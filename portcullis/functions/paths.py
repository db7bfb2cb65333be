"""What can be told from a path or an import string alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark a policy module.
POLICY_INDICATORS = ("authz", "opa", "policy", "rego", "cedar", "verifiedpermissions", "verified-permissions", "enforce", "open-policy-agent")
# Directories and extensions of front ends.
FRONTEND_DIRECTORIES = ("web", "webapp", "client", "frontend", "ui")
FRONTEND_EXTENSIONS = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "html", "htm", "css", "scss", "sass", "less", "vue", "svelte", "astro")
# Extension -> language; tsx and jsx are variants.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "java": "java",
    "py": "python", "pyi": "python", "go": "go", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "rb": "ruby", "rake": "ruby", "php": "php", "phtml": "php",
}
# Names in a path that suggest authorization code, between separators.
AUTHZ_PATH = (
    r"(?iuU)(?:^|[/\\_.\-])(?:authz|authn|authori[sz]ation|authorit\w*|authenticat\w*|rbac|abac|acl|iam|permissions?|roles?|polic(?:y|ies)|guards?"
    r"|access[_\-]?control)(?:[/\\_.\-]|$)"
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; '' if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def language(path: Column) -> Column:
    by_extension = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.when(file_name(path) == "Rakefile", "ruby").otherwise(by_extension[extension(path)])


def is_tsx_jsx(path: Column) -> Column:
    return extension(path).isin("tsx", "jsx")


def surface(path: Column) -> Column:
    """frontend if a directory says so and the file is a front end's, else backend."""
    inside = path.rlike(rf"(?i)(^|[\\/])({'|'.join(FRONTEND_DIRECTORIES)})[\\/]")
    return F.when(inside & extension(path).isin(*FRONTEND_EXTENSIONS), "frontend").otherwise("backend")


def is_policy_path(source: Column) -> Column:
    """An import string that names a policy module."""
    return F.lower(source).rlike("|".join(POLICY_INDICATORS))


def is_policy_implementation(path: Column) -> Column:
    """A file inside a policy module: some directory of its path carries an indicator."""
    return F.lower(F.regexp_replace(path, r"[^/]*$", "")).rlike("|".join(POLICY_INDICATORS))


def priority(path: Column) -> Column:
    """1 if the path looks like authorization code, else 0."""
    return F.when(path.rlike(AUTHZ_PATH), 1).otherwise(0)


def package_dir(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def _stem(path: Column) -> Column:
    """Without extension and without a leading src or lib directory."""
    return F.regexp_replace(without_extension(path), r"^(src|lib)/(?=.)", "")


def _prefixed(prefix: str, name: Column) -> Column:
    return F.when(name == "", F.lit(prefix)).otherwise(F.concat(F.lit(f"{prefix}."), name)) if prefix else name


def rego_package(path: Column, prefix: str = "") -> Column:
    """src/api/my-orders.ts with prefix app -> app.api.my_orders"""
    name = F.regexp_replace(F.translate(F.translate(_stem(path), "/\\", ".."), "-", "_"), r"[^\p{IsAlphabetic}\p{N}._]", "")
    segments = F.transform(F.split(name, r"\."), lambda s: F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s))
    return _prefixed(prefix, F.array_join(segments, "."))


def cedar_label(path: Column, prefix: str = "") -> Column:
    return _prefixed(prefix, F.translate(F.translate(_stem(path), "/\\", ".."), "-", "_"))


def policy_path(path: Column, engine: str, output_dir: str, prefix: str = "") -> Column:
    """Where the policies of a source file go; parent references are dropped. A Cedar prefix is a directory."""
    parts = F.filter(F.split(_stem(path), "/"), lambda p: ~p.isin("", ".", ".."))
    root = [output_dir.rstrip("/"), *([prefix] if prefix and engine == "cedar" else [])]
    return F.concat(F.lit("/".join(root) + "/"), F.array_join(parts, "/"), F.lit(f".{engine}"))
