"""Column functions on text: all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
SPACE = r"(?U)\s+"
#: What SPACE has runs of: the characters of Unicode's property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Words of failure messages by kind, in this order, and where sentences are split.
FAILURE_WORDS = {"authentication": ["authentication", "401", "api key"], "quota": ["credit", "quota", "billing"], "rate_limit": ["rate limit", "429"]}
SENTENCE_END = r"(?<=[.!?;])\s+(?=[A-Z(\[])"
# Fixed value: the namespace of chunk ids.
NAMESPACE = "6f4d6f1e-1a7b-4d5f-9a6c-9d4a2b3c1e70"


def let(value: Column, body) -> Column:
    """body of value, with value computed once and not wherever body names it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_tag(raw: Column) -> Column:
    """Lower case, inner white space to hyphens, no hyphens at the ends, 64 characters at most."""
    joined = F.replace(F.lower(collapse(raw)), F.lit(" "), F.lit("-"))
    return F.substring(F.regexp_replace(joined, r"^-+|-+\z", ""), 1, 64)


def file_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def content_fingerprint(text: Column) -> Column:
    """The same for texts that differ in white space or case only."""
    return F.sha2(F.lower(collapse(text)), 256)


def decode(content: Column) -> Column:
    """UTF-8 where valid (a byte order mark stays), else Latin-1; line ends become \\n."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def counted(words: Column) -> Column:
    """Distinct words of an array, in order, as struct(term, tf): where each begins in the sorted array, and
    how far it is to the next."""
    begins = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    runs = lambda w, at: F.transform(at, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(w)) - i).cast("long").alias("tf")))
    return F.when(F.size(words) > 0, let(F.sort_array(words), lambda w: let(begins(w), lambda at: runs(w, at))))


def tokens(text: Column) -> Column:
    """Words and single punctuation marks, the default unit of chunk budgets."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def sentences(text: Column) -> Column:
    """Parts that end in .!?; where the next begins with a capital or a bracket."""
    parts = F.transform(F.split(text, SENTENCE_END, -1), strip)
    return F.filter(parts, lambda p: p != "")


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 8).cast("string"), 10, 16))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def chunk_embedding_text(heading_path: Column, text: Column) -> Column:
    return F.concat_ws("\n\n", F.when(heading_path != "", heading_path), text)


def chunk_id(document_id: Column, content_hash: Column) -> Column:
    return uuid5(F.concat_ws(":", document_id, content_hash))


def cut_passage(text: Column, max_chars: Column | int) -> Column:
    """The first max_chars characters, cut at the last space in them, and ' ...'."""
    limit = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    head = F.substring(text, F.lit(1), limit)
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(head, r" [^ ]*\z", ""), F.lit(" ..."))).otherwise(text)


def lead_text(body: Column, limit: int = 600) -> Column:
    return F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("..."))).otherwise(body)


def hash_vector(text: Column, dimensions: int) -> Column:
    """A unit vector from the bytes of the text's SHA-256, for tests without a model."""
    byte = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    spread = lambda b: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: ((F.get(b, i % 32) + i) % 251) / F.lit(251.0))
    norm = lambda raw: F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    raw = let(let(F.sha2(text, 256), byte), spread)
    return let(raw, lambda r: let(norm(r), lambda n: F.when(n > 0, F.transform(r, lambda x: x / n)).otherwise(r)))


def tag_list(raw: Column) -> Column:
    """Tags from one form value: a JSON array, or else a comma list; blank parts are left out."""
    value = strip(F.coalesce(raw, F.lit("")))
    parsed = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    return F.coalesce(parsed, F.filter(F.split(value, ","), lambda p: strip(p) != ""))


def failure_kind(message: Column) -> Column:
    """connection, authentication, quota, rate_limit or other, in this order."""
    low = F.lower(message)
    kind = F.when(low.contains("connect") & ~low.contains("mcp"), "connection")
    for name, words in FAILURE_WORDS.items():
        kind = kind.when(F.exists(F.array(*[F.lit(w) for w in words]), low.contains), name)
    return kind.otherwise("other")
