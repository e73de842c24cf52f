"""Text expressions: normal form, tokens, hashed embedding, guards, paths, dates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The size of the hashed embedding; tokens are runs of Latin letters
# and digits with inner - _ . (among them the two letters that count as i and s
# whatever their case) and the characters and pairs of Han runs, of the blocks
# U+3400 to U+4DBF and U+4E00 to U+9FFF.
EMBEDDING_SIZE = 96
LATIN_TOKEN = "[a-z0-9\u0131\u017f]+(?:[-_.][a-z0-9\u0131\u017f]+)*"
HAN_RUN = "[\u3400-\u4dbf\u4e00-\u9fff]+"
# The characters that count as blank, those of Unicode and not of ASCII only.
BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """``text`` without the blanks at its ends, whatever their script."""
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def normal_text(text: Column) -> Column:
    """Lower case, runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), f"[{BLANKS}]+", " "))


def tokens(text: Column) -> Column:
    """Latin tokens as they stand; of a Han run its characters, then its pairs."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"({LATIN_TOKEN}|{HAN_RUN})"), 1)

    def parts(run: Column) -> Column:
        n = F.length(run)
        single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))
        return F.when(run.rlike(HAN_RUN), F.concat(single, F.coalesce(pairs, F.array().cast("array<string>")))).otherwise(F.array(run))

    return F.flatten(F.transform(runs, parts))


def hash_slot(token: Column, size: int = EMBEDDING_SIZE) -> Column:
    """The dimension of a token: the first 32 bits of its SHA-256, modulo the size."""
    return F.pmod(F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def hash_sign(token: Column) -> Column:
    """+1 if the fifth byte of its SHA-256 is odd, else -1."""
    odd = F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 1
    return F.when(odd, 1).otherwise(-1)


def count_matches(text: Column, pattern: str) -> Column:
    """Number of characters of ``text`` that match a character class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The name of the first condition that holds; null if none does."""
    chain = None
    for condition, name in cases:
        chain = F.when(condition, name) if chain is None else chain.when(condition, name)
    return chain


def failed_names(**checks: Column) -> Column:
    """Names, in order, of the checks that don't hold; a null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def active_on(valid_from: Column, valid_until: Column, day: Column) -> Column:
    """Inclusive validity; a null bound is unknown and doesn't limit."""
    return F.coalesce(valid_from <= day, F.lit(True)) & F.coalesce(valid_until >= day, F.lit(True))


# Which part of an entry's scope an attribute of the query is held against.
SCOPE_OF = {
    "artifact_type": "artifact_types", "artifact_types": "artifact_types", "material": "materials", "materials": "materials",
    "modality": "modalities", "modalities": "modalities", "craft": "crafts", "crafts": "crafts", "region": "regions", "regions": "regions",
}
SCOPE_PARTS = ("artifact_types", "materials", "modalities", "crafts", "regions", "tags")


def wanted_values(value) -> Column:
    """An attribute of a query, a text or a list of texts, as an array of its distinct values in normal form; blank ones are left out."""
    texts = [F.lit(v) for v in ([value] if isinstance(value, str) else value or ()) if isinstance(v, str)]
    known = F.transform(F.array(*texts).cast("array<string>"), normal_text)
    return F.array_distinct(F.filter(known, lambda v: v != ""))


def scope_compatible(attributes: dict, scope: Column) -> Column:
    """Whether an entry's scope, a map of lists, admits a query's attributes.

    Each attribute that names a part of the scope meets that part: they share a
    value, or the part has a wildcard. Attributes without values, and those that
    name no part, don't limit; a part that the scope lacks admits nothing.
    """
    met = [
        (F.size(wanted) == 0) | F.coalesce(F.arrays_overlap(F.array_append(wanted, "*"), F.transform(scope[SCOPE_OF[name]], normal_text)), F.lit(False))
        for name, wanted in ((name, wanted_values(value)) for name, value in attributes.items() if name in SCOPE_OF)
    ]
    return F.forall(F.array(F.lit(True), *met), lambda ok: ok)


def unsafe_path(path: Column) -> Column:
    """Absolute, drive-relative, parent-climbing, or with control or direction marks."""
    return (
        path.rlike(r"^[/\\]") | path.rlike(r"^[A-Za-z]:") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)")
        | path.rlike(r"[\x00-\x1f\x7f]") | path.rlike("[‎‏‪-‮⁦-⁩]")
    )


def has_control(text: Column) -> Column:
    """Control (Cc) or format (Cf) characters in the text."""
    return text.rlike(r"[\p{Cc}\p{Cf}]")


def canonical_angle(angle: Column) -> Column:
    """The whole-object view a label names; null for any other label."""
    cleaned = F.regexp_replace(F.regexp_replace(F.upper(F.trim(angle)), "[- ]", "_"), "_+", "_")
    aliases = F.create_map(*[F.lit(x) for pair in ANGLE_ALIASES.items() for x in pair])
    known = F.coalesce(F.try_element_at(aliases, cleaned), cleaned)
    return F.when(known.isin(*ANGLES), known)


# The view labels that count as whole-object angles, and their aliases.
ANGLES = (
    "FRONT", "BACK", "LEFT_PROFILE", "RIGHT_PROFILE", "TOP", "BASE", "INTERIOR",
    "FRONT_LEFT_45", "FRONT_RIGHT_45", "BACK_LEFT_45", "BACK_RIGHT_45",
)
ANGLE_ALIASES = {"LEFT": "LEFT_PROFILE", "RIGHT": "RIGHT_PROFILE", "BOTTOM": "BASE", "UNDERSIDE": "BASE", "REVERSE": "BACK"}


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever columns it came with."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def sequence_hint(name: Column) -> Column:
    """The number in brackets before a file name's extension, as in "vase (3).jpg"; null without one."""
    return F.nullif(F.regexp_extract(name, r"\(([0-9]+)\)\.[A-Za-z0-9]+$", 1), F.lit("")).try_cast("bigint")


def safe_file_name(path: Column, longest: int = 180) -> Column:
    """The last part of a path, trailing slashes aside, without NUL, cut to ``longest`` characters; "artifact-image" if nothing is left."""
    name = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    name = F.left(F.regexp_replace(name, "\\x00", ""), F.lit(longest))
    return F.when(F.coalesce(name, F.lit("")).isin("", "."), "artifact-image").otherwise(name)


def utc_time(text: Column) -> Column:
    """The moment that an ISO time with a zone names; null for any other text, and for times without zone."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
