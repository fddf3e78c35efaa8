"""Patterns, tokenizers and the suffix stemmer, as Column expressions.

Patterns are built from word lists and kept free of look-arounds and back-references, so the
same text runs in Java's and in RE2's dialect. An end of text is written ``\\z``: a ``$`` would
also match before a last newline.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(words: Iterable[str]) -> str:
    """An alternation, longest first so that no word hides a longer one."""
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


# --- paths

_DEAD_FOLDERS = ("docs", "storage", "node_modules", "vendor", "bootstrap/cache")
_LOCK_FILES = ("yarn.lock", "composer.lock", "pnpm-lock.yaml", "package-lock.json")
_NOTICES = ("LICENSE", "CHANGELOG", "README")
#: Paths that carry no signal for mining: dependencies, lock files, notices, minified code.
EXCLUDED_PATH = (
    "(?i)^(?:"
    + any_of(_DEAD_FOLDERS)
    + "/|"
    + any_of(re.escape(f) for f in _LOCK_FILES)
    + r"\z|"
    + any_of(_NOTICES)
    + r"(?:\.|\z)|.*\.min\."
    + any_of(["css", "js"])
    + r"\z)"
)
#: Files of documentation only, and of dependencies only.
DOCS_PATH = r"(?i)(?:^docs/|\." + any_of(["md", "mdx", "rst", "txt"]) + r"\z)"
DEPENDENCY_PATH = r"(?i)(?:^|/)" + any_of(re.escape(f) for f in (*_LOCK_FILES, "package.json", "composer.json")) + r"\z"
_SETTINGS = ("session", "services", "queue", "mail", "logging", "filesystems", "database", "cache", "auth", "app")
#: Paths that are never shown as anchors: generated and seeded files, settings, manifests.
NOISE_PATH = "|".join(
    [
        "(?i:/" + any_of(["factories", "fixtures?", "seeders?", "stubs?"]) + "/)",
        "(?i:^stubs?/)",
        "^database/migrations/",
        r"\.generated\.",
        "^config/" + any_of(_SETTINGS) + r"\.php\z",
        r"(?:composer\.(?:lock|json)|package(?:-lock)?\.json)\z",
        r"(?i:^(?:readme|changelog)\.md\z)",
        r"^\.(?:gitignore\z|env)",
    ]
)
#: Scaffolding that tests share.
FIXTURE_PATH = "^tests/" + any_of(["Fixtures/", "Factories/", r"TestCase\.php\z", r"ModelFactories\.php\z"])
TEST_PATH = r"(?i)(?:^tests?/|/__tests__/|\." + any_of(["test", "spec"]) + r"\.[a-z]+\z|Test\.php\z)"


def glob_swallow(glob: str) -> str:
    """A glob whose ``**`` also takes the slash after it, so ``a/**/b`` matches ``a/b``."""
    return _glob(glob, True)


def glob_plain(glob: str) -> str:
    """A glob whose ``**`` takes anything but leaves the slash after it."""
    return _glob(glob, False)


def _glob(glob: str, swallow: bool) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            i += 2
            out += ".*"
            if swallow and glob.startswith("/", i):
                out, i = out[:-2] + "(?:.*/)?", i + 1
            continue
        c = glob[i]
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return f"^{out}\\z"


def normal_path(path: Column) -> Column:
    """A path as plans write it, made comparable: quotes, back slashes, drive, repeats, leading and trailing marks go."""
    p = F.regexp_replace(F.trim(path), "^[\"'`]+|[\"'`]+\\z", "")
    p = F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "^[A-Za-z]:", "")
    p = F.regexp_replace(p, "/+", "/")
    p = F.regexp_replace(p, r"^(?:\./)+", "")
    return F.regexp_replace(F.regexp_replace(p, "^/+", ""), r"/+\z", "")


# --- words

_FILLER = """a about again against also am an and are as at be been being between but by can could did do does during
    else for from further had has have he how i if in into is it its just may me might must my no not of off on only or
    our out over own same shall she should so such than that the their them then these they this those through to too
    under very was we were what when where which while who whom why will with would you your"""
_EMPTY_VERBS = """add correctly currently fix make need needed needs now please properly something still stuff thing
    things use using want wants"""
PROMPT_STOPWORDS = frozenset(_FILLER.split()) | frozenset(_EMPTY_VERBS.split())
#: Words of commit texts that carry nothing: common ones, and the language's own.
CORPUS_STOPWORDS = frozenset(
    """abstract all and any are been being but can catch class const could did does extends final for from function had
    has have implements interface into its namespace new not onto php private protected public return should static
    that the this throw trait try use was were will with would""".split()
)
#: Suffixes in the order in which they are tried.
SUFFIXES = tuple("ations ation tions tion ings ing ies edly ed ly es er s".split())


def stem(word: Column) -> Column:
    """Cuts the first suffix that leaves more than two letters; ``ies`` becomes ``y``. Words of three letters stay."""
    out = None
    for s in SUFFIXES:
        fits = word.endswith(s) & (F.length(word) > len(s) + 2)
        cut = F.substr(word, F.lit(1), F.length(word) - len(s))
        cut = F.concat(cut, F.lit("y")) if s == "ies" else cut
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return F.when(F.length(word) <= 3, word).otherwise(out.otherwise(word))


def _in(words: Iterable[str], x: Column) -> Column:
    return x.isin(*sorted(words))


def prompt_tokens(text: Column) -> Column:
    """Stemmed content words of a prompt, in order, repeats kept."""
    raw = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    long_enough = F.filter(raw, lambda w: (F.length(w) >= 3) & ~_in(PROMPT_STOPWORDS, w))
    return F.filter(F.transform(long_enough, stem), lambda w: (F.length(w) >= 3) & ~_in(PROMPT_STOPWORDS, w))


def _camel(s: Column, lower: str) -> Column:
    s = F.regexp_replace(s, f"([{lower}])([A-Z])", "$1 $2")
    return F.regexp_replace(s, "([A-Z]{1,})([A-Z][a-z])", "$1 $2")


def corpus_tokens(text: Column) -> Column:
    """Words of a commit text or path: split at space, slashes, ``_``, ``-`` and camel case; no stemming."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"\.php\b", "")
    parts = F.split(F.lower(_camel(F.regexp_replace(s, r"[\s/\\_-]+", " "), "a-z")), r"\s+")
    return F.filter(parts, lambda w: (F.length(w) >= 3) & ~_in(CORPUS_STOPWORDS, w))


def _path_words(s: Column) -> Column:
    parts = F.split(F.lower(_camel(F.regexp_replace(s, r"[/._-]+", " "), "a-z0-9")), r"\s+")
    return F.transform(F.filter(parts, lambda w: F.length(w) >= 3), stem)


def path_tokens(path: Column) -> tuple[Column, Column]:
    """Stemmed words of a path: all of them, and those of the file's name without its extension."""
    folder = F.regexp_extract(path, "^(.*)/", 1)
    name = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?i)\.[a-z0-9]+\z", "")
    return F.concat(_path_words(folder), _path_words(name)), _path_words(name)


# --- compositional prompts

_VERSUS = r"(?:vs\.?|versus)"


def _two(left: str, between: str, end: str = "") -> str:
    """What is compared: the shortest first side, the rest as the second."""
    return rf"(?i){left}(.+?)\s+{between}\s+(.+){end}"


_COMPARISONS = (
    r"(?is)" + any_of(["inspect", "audit", "review"]) + r"\s+(.+?)\s+" + any_of(["with", "alongside", "and"]) + r"\s+"
    + any_of(["surface", "spot", "identify", "find"]) + r"\s+" + any_of(["issues", "gaps", "differences", "bugs"])
    + r".*?\b" + any_of(["against", r"compared\s+to", r"vs\.?"]) + r"\s+(.+)",
    _two(r"\bgaps?\s+" + any_of(["of", "in", "between"]) + r"\s+", any_of(["against", r"compared\s+to", _VERSUS])),
    _two(r"\bdifferences?\s+between\s+", "and"),
    _two("", r"compared\s+" + any_of(["against", "with", "to"])),
    _two("^", _VERSUS, r"\z"),
    _two("", "against"),
)
_LABEL_STOPWORDS = frozenset("a an and code codebase for i implementation implementations in just like need of on or please really the to usual want would".split())


def _plain(s: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " ")), " "), lambda w: w != "")


def subjects(prompt: Column) -> Column:
    """An array of (label, text): two subjects if the prompt compares them, else the prompt alone.

    The forms are tried in order; one whose sides have fewer than three words falls through to the next.
    """
    text = F.trim(prompt)
    out = None
    for p in _COMPARISONS:
        a, b = (F.trim(F.regexp_extract(text, p, k)) for k in (1, 2))
        fits = (F.size(_plain(a)) >= 3) & (F.size(_plain(b)) >= 3)
        both = F.array(*[F.struct(label(x).alias("label"), x.alias("text")) for x in (a, b)])
        out = F.when(fits, both) if out is None else out.when(fits, both)
    return out.otherwise(F.array(F.struct(F.lit("").alias("label"), prompt.alias("text"))))


def label(subject: Column) -> Column:
    """The first four content words of a subject, or its first 40 characters."""
    words = F.slice(F.filter(_plain(subject), lambda w: ~_in(_LABEL_STOPWORDS, w)), 1, 4)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.substr(F.trim(subject), F.lit(1), F.lit(40)))


# --- explicit mentions in prompts

def mentions(text: Column) -> Column:
    """Paths, qualified classes, class names and methods that a prompt names, as an array of (kind, value)."""
    path = F.regexp_extract_all(text, F.lit(r"((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z]{1,5})"), 1)
    fqcn = F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z0-9_]*(?:\\[A-Z][A-Za-z0-9_]*)+)"), 1)
    method = F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z0-9_]*::[a-z][A-Za-z0-9_]*)"), 1)
    pascal = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][0-9a-z]+(?:[A-Z][0-9A-Za-z]*){1,})\b"), 1), lambda w: F.length(w) > 4)
    kinds = (("path", path), ("fqcn", fqcn), ("method", method), ("class", pascal))

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.array_distinct(F.concat(*[tagged(k, c) for k, c in kinds]))
