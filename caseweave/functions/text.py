"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in the source of the texts, the Unicode spaces included (fixed value).
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same characters, for Python.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Edge of a word of ASCII letters, digits and underscore (fixed values).
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Words that carry no meaning (fixed values).
STOP_WORDS = "della delle dello degli nella nelle nello negli dalla dalle dallo dagli sulla sulle sullo sugli alla alle allo agli questo questa questi queste quello quella sono stato stata stati state essere avere viene vengono come anche dopo prima durante presso tramite senza verso dove quando perché mentre".split()


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def text_words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def long_words(text: Column, over: int) -> Column:
    """The words of more than `over` characters, in lower case."""
    return F.filter(F.split(F.lower(text), SPACE + "+"), lambda w: F.length(w) > over)


def keywords(text: Column, most: int = 30) -> Column:
    """The first `most` words of more than 3 characters that are no stop words."""
    return F.slice(F.filter(long_words(text, 3), lambda w: ~w.isin(STOP_WORDS)), 1, most)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts by their words of more than 3 characters: 1 if both have none, 0 if one has none."""
    x, y = F.array_distinct(long_words(a, 3)), F.array_distinct(long_words(b, 3))
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(shared / (F.size(x) + F.size(y) - shared))


def same_event(title_a: Column, title_b: Column, text_a: Column, text_b: Column) -> Column:
    """Titles over 0.6 similar, or three keywords of the first text (repeats count) found in the second."""
    other = keywords(text_b)
    return (jaccard(title_a, title_b) > 0.6) | (F.size(F.filter(keywords(text_a), lambda w: F.array_contains(other, w))) >= 3)


def file_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / (1 << 20)), F.lit(" MB")))


def confidence_label(n: Column, high: str = "alta", middle: str = "media", low: str = "bassa") -> Column:
    return F.when(n >= 80, high).when(n >= 50, middle).otherwise(low)


#: Reliability of source types; others count 50 (fixed values).
RELIABILITY = {"cartella_clinica": 100, "referto_controllo": 90, "esame_strumentale": 90, "esame_ematochimico": 70, "altro": 50}


def reliability(source: Column) -> tuple[Column, Column]:
    """Score of a source type and its label."""
    score = F.coalesce(F.create_map(*[F.lit(x) for p in RELIABILITY.items() for x in p])[source], F.lit(50))
    return score, F.when(score >= 80, "alta").when(score >= 60, "media").otherwise("bassa")


def excerpt(text: Column, query: str, around: int = 80, always_dots: bool = False) -> Column:
    """What stands `around` the first occurrence of query (any case); without one the first 2 x `around` characters."""
    at = F.instr(F.lower(text), query.lower())
    start = F.greatest(at - 1 - around, F.lit(0))
    end = F.least(at - 1 + len(query) + around, F.length(text))
    found = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))
    dots = F.lit("...") if always_dots else F.when(F.length(text) > 2 * around, "...").otherwise("")
    return F.when(at > 0, found).otherwise(F.concat(F.substring(text, 1, 2 * around), dots))


def search_term(raw: str) -> str | None:
    """A query without wildcard and punctuation characters, trimmed; None if under two characters are left."""
    term = "".join(" " if c in ",.()[]{}\\%_" else c for c in raw).strip()
    return term if len(term) >= 2 else None


def slug(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), r"[^a-zà-ú0-9\s]", "")
    return F.substring(F.regexp_replace(kept, r"\s+", "_"), 1, 40)


#: Headings of report sections in order of precedence (fixed values).
SECTION_IDS = [
    (r"riassunto\s+(del\s+)?caso", "riassunto"), (r"cronologia\s+medico", "cronologia"), (r"analisi\s+dell.intervento", "analisi_intervento"), (r"complicanze", "complicanze"),
    (r"danno\s+biologico", "danno_biologico"), (r"nesso\s+causale", "nesso_causale"), (r"timeline\s+diagnostica", "timeline_diagnostica"), (r"analisi\s+del\s+ritardo", "analisi_ritardo"),
    (r"perdita\s+di\s+chance|loss\s+of\s+chance", "loss_of_chance"), (r"analisi\s+del\s+travaglio", "analisi_travaglio"), (r"tracciato\s+cardiotocografico|ctg", "ctg_analisi"), (r"esiti\s+neonatali", "esiti_neonatali"),
    (r"valutazione\s+preoperatoria", "valutazione_preoperatoria"), (r"gestione\s+anestesiologica", "gestione_anestesiologica"), (r"analisi\s+dell.infezione", "analisi_infettiva"), (r"gestione\s+terapeutica", "gestione_terapeutica"),
    (r"percorso\s+diagnostico", "percorso_diagnostico"), (r"analisi\s+dell.errore", "analisi_errore"), (r"elementi\s+di\s+rilievo", "elementi_rilievo"), (r"profili\s+di\s+responsabilit", "profili_responsabilita"),
    (r"valutazione\s+di\s+merito", "valutazione_merito"),
]


def section_id(heading: Column) -> Column:
    """The id of a section by the first pattern its heading matches, else its slug."""
    found = slug(heading)
    for pattern, name in reversed(SECTION_IDS):
        found = F.when(heading.rlike("(?i)" + pattern), name).otherwise(found)
    return found


def escaped(text: Column) -> Column:
    """Text for XML or HTML."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def ocr_confidence(text: Column) -> Column:
    """0 for under 10 characters, else 90 less 5 for each illegible mark (40 at most) plus a tenth of the words (10 at most), held between 10 and 100."""
    marks = F.regexp_count(F.lower(text), F.lit(r"\[illeggibile\]"))
    words = F.size(F.split(text, SPACE + "+"))
    value = F.floor(90 - F.least(5 * marks, F.lit(40)) + F.least(words / 10, F.lit(10.0)) + 0.5)
    return F.when(F.length(text) < 10, 0).otherwise(F.greatest(F.least(value, F.lit(100)), F.lit(10))).cast("long")


def folded(value: Column, valid: list[str], aliases: dict[str, str], default: str = "altro") -> Column:
    """A declared value as it is; else the one its normal form (lower case, runs of spaces, - and _ as one _) is an alias of, or `default`."""
    pairs = [F.lit(x) for pair in aliases.items() for x in pair]
    normal = F.regexp_replace(F.lower(value), r"[\s_-]+", "_")
    return F.when(value.isin(valid), value).otherwise(F.coalesce(F.create_map(*pairs)[normal], F.lit(default)))
