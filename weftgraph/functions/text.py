"""Scalar functions on names, paths and contents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of paths that mark test files (fixed values).
TEST_INSIDE = [".test.", ".spec.", "__tests__/", "__mocks__/", "/test/", "/tests/", "/testing/", "/fixtures/", "/spec/", "/test_", "/conftest."]
TEST_ENDS = ["_test.go", "_test.py", "_spec.rb", "_test.rb"]
#: The wider list for entry points (fixed values).
ENTRY_TEST_INSIDE = [
    ".test.", ".spec.", "__tests__/", "__mocks__/", "/test/", "/tests/", "/testing/", "/test_", "/src/test/", "uitests/", ".tests/", ".test/",
    ".integrationtests/", ".unittests/", "/testproject/", "/spec/",
]
ENTRY_TEST_ENDS = ["_test.py", "_test.go", "tests.swift", "test.swift", "tests.cs", "test.cs", "test.php", "spec.php", "_spec.rb", "_test.rb"]
#: Parts of paths that mark utility files (fixed values).
UTILITY_INSIDE = ["/utils/", "/util/", "/helpers/", "/helper/", "/common/", "/shared/", "/lib/"]
UTILITY_ENDS = ["/utils.ts", "/utils.js", "/helpers.ts", "/helpers.js", "_utils.py", "_helpers.py"]


def quote(text: str) -> str:
    """``text`` as a regular expression that means just itself."""
    return "".join(f"\\{c}" if c in r".^$*+?{}[]\|()-" else c for c in text)


def _path_test(path: Column, inside: list[str], ends: list[str]) -> Column:
    pattern = "|".join([*map(quote, inside), *(quote(e) + "$" for e in ends)])
    return F.rlike(F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))), F.lit(pattern))


def is_test_path(path: Column) -> Column:
    return _path_test(path, TEST_INSIDE, TEST_ENDS)


def is_entry_test_path(path: Column) -> Column:
    return _path_test(path, ENTRY_TEST_INSIDE, ENTRY_TEST_ENDS)


def is_utility_path(path: Column) -> Column:
    return _path_test(path, UTILITY_INSIDE, UTILITY_ENDS)


def matches_whole(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whole-string regular expression match (a graph query's ``=~``)."""
    return F.rlike(text, F.lit(f"{'(?i)' if ignore_case else ''}^(?:{pattern})$"))


def sanitize(text: Column) -> Column:
    """Unix line ends, no control characters but tab and line feed."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F￾￿]", "")


def looks_binary(text: Column) -> Column:
    """More than a tenth of the first 1000 characters are not printable."""
    head = F.substring(text, 1, 1000)
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0E-\x1F\x7F]", ""))
    return (F.length(head) > 0) & (odd * 10 > F.length(head))


def truncate(text: Column, limit: int = 10_000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n... [truncated]"))).otherwise(text)


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def sanitize_id(text: Column) -> Column:
    """Lower case, other characters than letters and digits become one underscore, at most 20 characters."""
    return F.substring(F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9]+", "_")), 1, 20)


def camel_to_kebab(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1-$2"))


def fingerprint(version: str, text: Column) -> Column:
    """SHA-1 of a version line and the text."""
    return F.sha1(F.concat_ws("\n", F.lit(version), text))


def short_description(text: Column, limit: int = 150) -> Column:
    """Cut at the last sentence end, else the last space, in the second half of the limit; else hard."""
    head = F.substring(text, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    word = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    cut = F.when(F.length(sentence) > limit / 2, sentence).when(F.length(word) > limit / 2, word).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def clean_content(text: Column) -> Column:
    """Unix line ends, no trailing blanks, at most one empty line in a row, nothing blank around the whole."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1), lambda x: F.rtrim(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def chunks(text: Column, size: int = 1200, overlap: int = 120) -> Column:
    """Array of (chunk, start, text): windows of ``size`` characters, each sharing ``overlap`` with the one before."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step) - 1, F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(k.alias("chunk"), (k * step).alias("start"), F.substring(text, k * step + 1, F.lit(size)).alias("text")),
    )


def line_of(text: Column, offset: Column) -> Column:
    """Number, from 1, of the line that holds a character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1


def replace_word(text: Column, old: str, new: str) -> Column:
    return F.regexp_replace(text, rf"\b{quote(old)}\b", new)


def reason_keys(reason: Column) -> Column:
    """Keys of an encoded reason ``...|keys:a,b|fetches:n``."""
    keys = F.regexp_extract(reason, r"\|keys:([^|]*)", 1)
    return F.filter(F.split(keys, ","), lambda k: k != "")


def reason_fetches(reason: Column) -> Column:
    return F.coalesce(F.try_to_number(F.regexp_extract(reason, r"\|fetches:(\d+)", 1), F.lit("999999999")).cast("int"), F.lit(1))


def strip_quotes(values: Column) -> Column:
    return F.transform(values, lambda v: F.regexp_replace(v, r"""^['"]|['"]$""", ""))


def entry_name_score(name: Column) -> Column:
    """Name factor of an entry point: 1.5 for entry-like names, 0.3 for accessors and helpers, else 1."""
    utility = r"^(?:get|set|is|has|can|should|will|did)[A-Z]|^_|^(?i:format|parse|validate|convert|transform|encode|decode|serialize|deserialize|clone|copy|deep|merge|extend|assign|filter|map|reduce|sort|find)|^(?i:log|debug|error|warn|info)$|^(?:to|from)[A-Z]|(?:Helper|Util|Utils)$"
    entry = r"^(?i:main|init|bootstrap|start|run|setup|configure)$|^(?i:handle|on|process|execute|perform|dispatch|trigger|fire|emit)[A-Z_]|(?:Handler|Controller)$"
    return F.when(F.rlike(name, F.lit(utility)), 0.3).when(F.rlike(name, F.lit(entry)), 1.5).otherwise(1.0)
