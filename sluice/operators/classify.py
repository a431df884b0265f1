"""Which columns of a result are sensitive, and as what: by name, by profile, or by an injected classifier."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.masks import KINDS
from sluice.functions.text import key_of, scalar, scope_of, sources_of
from sluice.operators.results import PLACE, quoted

NONE = "none"
DISTINCT = 16
PROBES = 400
CACHED = 512

# The names and forms by which columns are told apart.
SAFE_KEYS = {
    "id", "ids", "rownum", "row_num", "count", "total", "status", "stato", "type", "tipo", "flag", "enabled", "active", "created_at", "updated_at", "deleted_at", "timestamp", "ts", "date", "data",
    "estero", "numrif", "num_rif", "cf", "codicefiscale", "codice_fiscale", "cod_fiscale", "codfiscale", "codfiscalerl", "partitaiva", "partita_iva", "piva", "vat", "pi",
}
SAFE_WORDS = {"id", "count", "total", "status", "stato", "type", "tipo", "flag", "enabled", "active", "created", "updated", "deleted", "timestamp", "date", "data"}
CODE_WORDS = {"codice", "code", "num", "numero", "rif", "numrif", "order", "ordine", "protocollo", "conto", "flag", "stato", "tipo", "estero"}
ENUM_WORDS = {"status", "stato", "type", "tipo", "flag", "estero"}
FLAGS = ["0", "1", "y", "n", "s", "no", "si", "yes", "true", "false", "t", "f"]
CODES = [r"(?i)^[A-Z]{1,5}\d{4,}[A-Z0-9_-]*$", r"(?i)^[A-Z0-9]{1,6}[-_/][A-Z0-9_-]{2,}$"]
ADDRESS_SIGN = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
NOT_PERSONAL = {"tipoiva", "regimeiva", "referenteiva"}
EXACT = {
    "email": ("email", "pec", "emailrl"),
    "phone": ("telefono", "telefonorl", "cellulare", "mobile", "fax"),
    "name": ("nome", "cognome", "nomerl", "cognomerl"),
    "org": ("denominazione", "ragionesociale"),
    "address": ("indirizzo", "address", "cap"),
    "city": ("citta", "comune", "provincia", "nazione"),
    "text": ("note", "comment", "memo"),
}


@dataclass(frozen=True)
class NameRule:
    """A kind, and what in a column's name tells of it: how the name without _ begins or ends, what it holds, one of its
    words, or the whole name."""

    kind: str
    starts: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    holds: tuple[str, ...] = ()
    words: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset()

    def fits(self, joined: str, words: set[str], key: str) -> bool:
        return joined.startswith(self.starts) or joined.endswith(self.ends) or any(h in joined for h in self.holds) or not words.isdisjoint(self.words) or key in self.names


# The rules, in the order in which they are tried.
RULES = (
    NameRule("email", starts=("email",), holds=("pec",), words=frozenset({"email", "mail", "pec"})),
    NameRule("phone", starts=("telefono", "cellulare"), ends=("phone",), words=frozenset({"telefono", "phone", "mobile", "cellulare", "fax"})),
    NameRule("name", starts=("nome", "cognome"), words=frozenset({"nome", "name", "cognome", "surname", "firstname", "lastname", "referente"})),
    NameRule("org", holds=("denominazione", "ragionesociale"), names=frozenset({"azienda", "societa", "company"})),
    NameRule("address", holds=("indirizzo", "address"), words=frozenset({"indirizzo", "address", "via", "street", "cap", "zip"})),
    NameRule("city", words=frozenset({"citta", "city", "comune", "provincia", "country", "nazione"})),
    NameRule("text", words=frozenset({"note", "comment", "memo"})),
)


class ClassifierError(RuntimeError):
    """The classifier that a target's mode demands is missing or failed."""


def kind_by_name(name: str) -> str | None:
    key = key_of(name)
    for kind, names in EXACT.items():
        if key in names:
            return kind
    joined, found = key.replace("_", ""), set(key.split("_"))
    if not key or joined in NOT_PERSONAL:
        return None
    return next((rule.kind for rule in RULES if rule.fits(joined, found, key)), None)


def safe_by_name(name: str) -> bool:
    key = key_of(name)
    return bool(key) and (key in SAFE_KEYS or set(key.split("_")) <= SAFE_WORDS)


def has_words(name: str, words: set[str]) -> bool:
    return bool(set(key_of(name).split("_")) & words)


def is_code(value: Column) -> Column:
    return ~value.contains("@") & (value.rlike(CODES[0]) | value.rlike(CODES[1]))


@dataclass(frozen=True)
class Profile:
    """Of all values with one normalized name: how many, some distinct ones, and whether all have a form."""

    key: str
    n_values: int
    n_distinct: int
    samples: tuple[str, ...]
    flag_like: bool
    code_like: bool
    enum_like: bool


def profile_columns(df: DataFrame) -> DataFrame:
    """(key, n_values, n_distinct, all_flags, all_codes, all_short, n_all) for each normalized column name: the columns
    unpivoted, in one aggregation; a task passes on a row for each column, with a sketch that tells up to its 64 values
    exactly apart (by a hash of 64 bits). n_all: the distinct values, DISTINCT + 1 at most; n_distinct: DISTINCT at most."""
    cells = [F.struct(F.lit(key_of(f.name)).alias("key"), scalar(_as_text(F.col(quoted(f.name)), f.dataType)).alias("value")) for f in df.schema.fields if f.name != PLACE]
    each = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("value <> '' and key <> ''")
    lower = F.lower("value")
    found = each.groupBy("key").agg(
        F.count("*").alias("n_values"),
        F.theta_sketch_agg("value", 6).alias("sketch"),
        F.bool_and(lower.isin(FLAGS)).alias("all_flags"),
        F.bool_and(is_code(F.col("value"))).alias("all_codes"),
        F.bool_and((F.length("value") <= 16) & ~F.col("value").rlike(ADDRESS_SIGN)).alias("all_short"),
    )
    n = F.theta_sketch_estimate("sketch")
    return found.select("key", "n_values", F.least(n, F.lit(DISTINCT)).alias("n_distinct"), "all_flags", "all_codes", "all_short", F.least(n, F.lit(DISTINCT + 1)).alias("n_all"))


def _as_text(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else value.cast("string")


def judged_profiles(df: DataFrame) -> DataFrame:
    """profile_columns() with the three forms that a name and a profile make together."""
    p = profile_columns(df)
    words = F.split("key", "_")
    by_name = F.col("key").isin(*SAFE_KEYS)
    coded = by_name | F.arrays_overlap(words, F.array(*map(F.lit, sorted(CODE_WORDS))))
    listed = by_name | F.arrays_overlap(words, F.array(*map(F.lit, sorted(ENUM_WORDS))))
    return p.select(
        "key", "n_values", "n_distinct",
        ((F.col("n_all") <= 4) & F.col("all_flags")).alias("flag_like"),
        (coded & F.col("all_codes")).alias("code_like"),
        (listed & (F.col("n_values") >= 2) & (F.col("n_all") <= 6) & F.col("all_short")).alias("enum_like"),
    )


def profiles(df: DataFrame) -> dict[str, Profile]:
    """judged_profiles() by key, for a bounded result: a row for each column reaches the driver."""
    return {r.key: Profile(r.key, r.n_values, r.n_distinct, (), r.flag_like, r.code_like, r.enum_like) for r in judged_profiles(df).collect()}


class KindCache:
    """Kinds that a classifier gave, by the query's sources and the column's key; the least recently used goes first."""

    def __init__(self, size: int = CACHED):
        self.size, self._kinds = size, OrderedDict()

    def get(self, scope: str, key: str) -> str | None:
        name = self.name(scope, key)
        if name in self._kinds:
            self._kinds.move_to_end(name)
        return self._kinds.get(name)

    def put(self, scope: str, key: str, kind: str) -> None:
        self._kinds[self.name(scope, key)] = normal_kind(kind)
        self._kinds.move_to_end(self.name(scope, key))
        while len(self._kinds) > self.size:
            self._kinds.popitem(last=False)

    def keys(self) -> list[str]:
        return list(self._kinds)

    @staticmethod
    def name(scope: str, key: str) -> str:
        return f"{(scope or '').strip().lower() or '__global__'}|{key}"


def normal_kind(kind: Any) -> str:
    word = str(kind or "").strip().lower()
    return word if word in KINDS else NONE


def field_probe(df: DataFrame, known: dict[str, Profile]) -> list[dict[str, Any]]:
    """What a classifier is shown of each column: a first value, up to five distinct ones, their number, and hints. The
    distinct ones are the smallest, each found by an aggregation above the one before, so that nothing is gathered."""
    names = [f for f in df.schema.fields if f.name != PLACE][:PROBES]
    texts = [_as_text(F.col(quoted(f.name)), f.dataType) for f in names]
    first = (lambda t: F.min_by(t, PLACE)) if PLACE in df.columns else F.first
    samples: list[list[str]] = [[] for _ in names]
    values = [F.when(scalar(t) != "", scalar(t)) for t in texts]
    row = df.agg(*(first(F.substring(t, 1, 80)).alias(f"f{k}") for k, t in enumerate(texts)), *(F.min(v).alias(f"v{k}") for k, v in enumerate(values))).first()
    found = row
    while open_ones := [k for k in range(len(names)) if f"v{k}" in found and found[f"v{k}"] is not None]:
        for k in open_ones:
            samples[k].append(found[f"v{k}"])
        more = [k for k in open_ones if len(samples[k]) < 5]
        if not more:
            break
        found = df.agg(*(F.min(F.when(values[k] > F.lit(samples[k][-1]), values[k])).alias(f"v{k}") for k in more)).first()
    out = []
    for k, f in enumerate(names):
        p = known.get(key_of(f.name))
        hints = {"flag_like": p.flag_like, "structured_code_like": p.code_like, "enum_like": p.enum_like} if p else None
        out.append({"key": f.name, "sample": row[f"f{k}"], "samples": samples[k], "distinct_count": p.n_distinct if p else 0, "technical_hint": hints})
    return out


Classifier = Callable[[dict[str, Any]], dict[str, str]]


def kinds_from_classifier(df: DataFrame, known: dict[str, Profile], classifier: Classifier, cache: KindCache, sql: str | None) -> dict[str, str]:
    """Kinds by key; the classifier is asked once, for the columns that the cache doesn't have."""
    scope = scope_of(sql)
    probes = field_probe(df, known)
    ask = [p for p in probes if cache.get(scope, key_of(p["key"])) is None]
    if ask:
        answer = classifier({"query_sources": sources_of(sql), "fields": ask})
        for p in ask:
            cache.put(scope, key_of(p["key"]), answer.get(p["key"]) if isinstance(answer, dict) else NONE)
    return {key_of(p["key"]): cache.get(scope, key_of(p["key"])) or NONE for p in probes}


def resolve(df: DataFrame, known: dict[str, Profile], *, mode: str = "hybrid", strategy: str = "hybrid", classifier: Classifier | None = None, fail_open: bool = False, cache: KindCache | None = None, sql: str | None = None) -> dict[str, str]:
    """Kinds from the classifier where mode and strategy want one.

    Mode llm-strict (direct is another word for it) demands an answer: without one it fails, unless fail_open. The
    strategy llm wants one but goes on by names. Mode deterministic never asks.
    """
    strict = mode in ("llm-strict", "direct")
    if not strict and (strategy == "heuristic" or mode in ("deterministic", "off")):
        return {}
    try:
        if classifier is None:
            if strict:
                raise ClassifierError("Field identification LLM unavailable: baseUrl/model missing.")
            return {}
        try:
            return kinds_from_classifier(df, known, classifier, cache or KindCache(), sql)
        except Exception as error:
            raise ClassifierError("Field identification LLM failed.") from error
    except ClassifierError:
        if strict and not fail_open:
            raise
        return {}
