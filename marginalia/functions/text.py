"""Scalar operators as Column expressions: they stay inside generated code and reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX_CITE = 10
SNIPPET = 160
BLOB_BYTES = 8192

# English words that carry no content for the precision gate.
STOPWORDS = (
    "a", "about", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have", "how",
    "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "not", "of", "on", "or", "our", "should", "so", "that", "the", "their", "them", "then",
    "there", "these", "they", "this", "to", "was", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your",
)

#: Path prefix or exact path -> ring; a prefix ends with "/", "" holds everything.
Rules = list[tuple[str, int]]


def ascii_lower(c: Column) -> Column:
    """A-Z only: hashes must not depend on Unicode case rules."""
    return F.translate(c, _UPPER, _LOWER)


def collapse(c: Column) -> Column:
    """One blank for each run of Unicode white space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(ascii_lower(collapse(c)), 256)


def citation(ring: Column, digest: Column) -> Column:
    return F.concat(F.lit("r"), ring.cast("string"), F.lit("-"), F.substring(digest, 1, _HEX_CITE))


def cite_hash(cite: Column) -> Column:
    return F.when(F.instr(cite, "-") > 0, F.substring_index(cite, "-", -1)).otherwise(cite)


def snippet(text: Column, ctx: Column | None = None) -> Column:
    short = F.substring(collapse(text), 1, SNIPPET)
    return short if ctx is None else F.when(F.coalesce(ctx, F.lit("")) != "", F.concat(F.lit("["), ctx, F.lit("] "), short)).otherwise(short)


def generated_blob(body: Column) -> Column:
    """A line beyond 8 KiB marks generated data."""
    return F.exists(F.split(body, "\n"), lambda line: F.octet_length(line) > BLOB_BYTES)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.octet_length(c) / F.lit(3.5)).cast("long")


def identifier(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def norm_stem(path: Column) -> Column:
    return identifier(F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"(.)\.[^.]*\z", "$1"))


def gate_words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def content_terms(c: Column) -> Column:
    """Distinct words in order, without stopwords."""
    return F.array_except(F.array_distinct(gate_words(c)), F.array(*map(F.lit, STOPWORDS)))


def covered_terms(terms: Column, words: Column) -> Column:
    """How many terms open some word."""
    return F.size(F.filter(terms, lambda t: F.exists(words, lambda w: F.startswith(w, t))))


def ring_of(path: Column, rules: Rules, default: int = 3) -> Column:
    """First rule that holds: "x/" for a subtree, "x" for one path, "" for all."""
    out = F.lit(default)
    for prefix, ring in reversed(rules):
        holds = F.lit(True) if not prefix else F.startswith(path, F.lit(prefix)) if prefix.endswith("/") else path == prefix
        out = F.when(holds, F.lit(ring)).otherwise(out)
    return out


def effective_ring(frontmatter: Column, location: Column, native: Column) -> Column:
    """Frontmatter over location; native stores at least 2; a location of 5 or more is not lowered."""
    base = F.when(location >= 5, F.greatest(location, F.coalesce(frontmatter, location))).otherwise(F.coalesce(frontmatter, location))
    return F.when(native, F.greatest(base, F.lit(2))).otherwise(base)


def frontmatter_ring(text: Column) -> Column:
    """``ring:`` of a closed leading block, 255 where it is no number from 0 to 255, null without one. The last one counts."""
    head = F.regexp_extract(F.regexp_replace(text, "^\ufeff", ""), r"(?s)^[ \t]*---[ \t]*\r?\n(.*?\n)??[ \t]*---[ \t]*(?:\r?\n|$)", 1)
    token = F.regexp_extract(head, r"(?si).*(?:^|\n)ring:[ \t]*([^\s]*)", 1)
    has = F.regexp_like(head, F.lit(r"(?i)(?:^|\n)ring:"))
    number = F.when(token.rlike(r"^\+?[0-9]{1,3}\z"), token.cast("int"))
    return F.when(has, F.when(number <= 255, number).otherwise(F.lit(255)))


def under_prefix(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | F.startswith(path, F.lit(p + "/"))
    return out


def slice_of(path: Column, slices: list[tuple[str, str]]) -> Column:
    """Name of the longest prefix that holds the path; of equals the first; "root" where none does."""
    ordered = sorted(enumerate(slices), key=lambda x: (-len(x[1][1]), x[0]))
    out = F.lit("root")
    for _, (name, prefix) in reversed(ordered):
        out = F.when(under_prefix(path, [prefix]), F.lit(name)).otherwise(out)
    return out


def prefixes_of(slices: list[tuple[str, str]], name: str | None) -> list[str]:
    """Prefixes of a slice by name. No name, or ``root``, restricts nothing; an unknown name raises before anything is read."""
    if name is None or name == "root":
        return []
    found = [prefix for n, prefix in slices if n == name]
    if not found:
        known = ", ".join(dict.fromkeys(n for n, _ in slices)) or "none"
        raise ValueError(f"no slice named {name!r} (configured: {known})")
    return found


def in_slice(path: Column, slices: list[tuple[str, str]], name: str | None) -> Column:
    prefixes = prefixes_of(slices, name)
    return under_prefix(path, prefixes) if prefixes else F.lit(True)


# Path components and file names that may hold credentials.
SECRET_FOLDERS = ("secrets", ".ssh", ".gnupg", ".aws")


def secret_path(path: Column) -> Column:
    low = ascii_lower(path)
    parts = F.split(low, r"[/\\]")
    base = F.element_at(parts, -1)
    return (
        F.arrays_overlap(parts, F.array(*map(F.lit, SECRET_FOLDERS)))
        | base.rlike(r"secret|credential|password|^\.env|\.(pem|key|keystore|p12|pfx|tfstate)\z")
        | base.isin("id_rsa", "id_ed25519")
    )


def indexable(path: Column, excluded: list[str]) -> Column:
    return F.endswith(path, F.lit(".md")) & ~under_prefix(path, excluded) & ~secret_path(path)


SECRET_PATTERNS = {
    "key_block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{13,}\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    "vendor_token": r"(sk-|ghp_|github_pat_)[A-Za-z0-9_-]{20,}",
    "access_key": r"AKIA[0-9A-Z]{16}",
    "assignment": r"(?i)(password|passwd|secret|token|api_?key)\s*[:=]\s*[A-Za-z0-9+/_.-]{8,}",
}


def secret_shape(text: Column) -> Column:
    """Name of the first shape found in a document, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECRET_PATTERNS.items()):
        out = F.when(F.regexp_like(text, F.lit(pattern)), F.lit(name)).otherwise(out)
    return out


def command_signature(command: Column) -> Column:
    """Commands that differ in paths, hashes or numbers only are alike."""
    words = F.filter(F.split(ascii_lower(command), r"(?U)\s+"), lambda w: w != "")
    plain = lambda w: F.regexp_replace(F.regexp_replace(w, "[0-9a-f]{8,}", "<hex>"), "[0-9]+", "n")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"[/\\]"), F.lit("<path>")).otherwise(plain(w))), " ")


def redact_runs(text: Column) -> Column:
    """The part of redaction that needs no state: tokens, long hex runs and login parts of addresses."""
    out = F.regexp_replace(text, r"eyJ[A-Za-z0-9_.-]{17,}", "[redacted]")
    out = F.regexp_replace(out, r"(://)[^\s/@:]*:[^\s/@]*@", "$1[redacted]@")
    return F.regexp_replace(out, r"[0-9A-Fa-f]{32,}", "[redacted]")


def clamp(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def host_name(c: Column) -> Column:
    clean = F.regexp_replace(c, "[^A-Za-z0-9_-]", "-")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("unknown-host")).otherwise(clean)


def human_bytes(n: Column) -> Column:
    size = n.cast("double")
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_number(size / 1024, 1), F.lit(" KiB"))).otherwise(F.concat(F.format_number(size / (1 << 20), 1), F.lit(" MiB")))


def position_cost(tokens: Column, index: Column, total: Column) -> Column:
    return tokens * F.greatest(F.lit(0), total - index)


def epoch_seconds(stamp: Column) -> Column:
    """Strict ISO-8601 with Z; anything else is null."""
    fine = stamp.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$")
    return F.when(fine, F.unix_timestamp(F.try_to_timestamp(F.concat(F.substring(stamp, 1, 19), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))))


BUCKETS = (32, 64, 128, 257, 512, 1024, 2048)


def token_bucket(n: Column) -> Column:
    fit = F.array_min(F.filter(F.array(*map(F.lit, BUCKETS)), lambda b: b >= n))
    return F.when(n > 0, fit)


def condense(output: Column, family: Column, head: int = 40, tail: int = 20, floor: float = 0.30) -> Column:
    """``text, elided``: long output keeps head and tail, unless it verifies something or too little is saved."""
    lines = F.split(F.regexp_replace(output, "\n$", ""), "\n")
    n = F.size(lines)
    keep = F.when(family == "vcs", F.lit(tail // 2)).otherwise(F.lit(tail))
    gone = n - head - keep
    short = F.concat_ws("\n", F.slice(lines, 1, head), F.concat(F.lit("… "), gone.cast("string"), F.lit(" line(s) elided …")), F.slice(lines, n - keep + 1, keep))
    saved = (F.octet_length(output) - F.octet_length(short)) / F.greatest(F.octet_length(output), F.lit(1))
    does = (family != "verification") & (n >= head + tail + 10) & (saved >= floor)
    return F.struct(F.when(does, short).otherwise(output).alias("text"), F.when(does, gone).otherwise(F.lit(0)).cast("long").alias("elided"))


def focus_score(path: Column, query: str) -> Column:
    """4 the path without its suffix, 3 its stem, 2 the end of it, 1 anywhere; null without a match."""
    q = query.lower().removesuffix(".md")
    bare = F.regexp_replace(F.lower(path), r"\.md$", "")
    stem = F.element_at(F.split(bare, "/"), -1)
    return F.when(bare == q, 4).when(stem == q, 3).when(F.endswith(bare, F.lit(q)), 2).when(F.contains(bare, F.lit(q)), 1)


def knowledge_kind(path: Column) -> Column:
    top = F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit(""))
    return F.when(top == "", "root").otherwise(top)
