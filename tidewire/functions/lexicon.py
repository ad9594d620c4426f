"""Synonym groups and the graph they make. Terms that share a group are synonyms; groups that share a term merge at
that term only."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import normalize_term, query_words

#: The default groups.
DEFAULT_GROUPS = """
feminicidio, femicidio, asesinato de mujer, homicidio de mujer, crimen de género, violencia feminicida, muerte violenta de mujer
niños, niñas, niña, niño, menores, menor, infantes, infante, adolescentes, adolescente, jóvenes, púberes, NNA, nna, hijos, hijas, hijo, hija, bebés, bebé, recién nacidos, neonatos, lactantes, pequeños, chicos, chicas, muchachos, muchachas, críos, crías, chavos, chavas, morritos, morritas
violencia, agresión, maltrato, abuso, lesiones, golpes, violencia física, violencia psicológica, violencia sexual, violencia doméstica, violencia familiar, violencia intrafamiliar, tortura, vejaciones, acoso, hostigamiento
huérfanos, huérfanas, huérfano, huérfana, orfandad, sin padres, sin madre, sin padre, abandonados, desamparados, víctimas indirectas, víctimas colaterales, hijos de víctimas
justicia, proceso legal, juicio, tribunal, sentencia, condena, absolución, veredicto, investigación, denuncia, querella, ministerio público, fiscalía, procuraduría, detención, arresto, captura, orden de aprehensión
protección, refugio, albergue, casa hogar, DIF, asistencia social, custodia, tutela, adopción, medidas cautelares, orden de restricción, alejamiento
madre, mamá, progenitora, genitora, materna
padre, papá, progenitor, genitor, paterno
familia, hogar, núcleo familiar, parientes, familiares
asesinato, homicidio, crimen, muerte violenta, occisión
víctima, afectada, perjudicada, damnificada, lesionada
agresor, atacante, perpetrador, victimario, criminal
denuncia, acusación, reporte, querella, demanda
investigación, pesquisa, indagatoria, averiguación
evidencia, prueba, indicio, elemento probatorio
testigo, declarante, deponente, informante
"""


def _normal(term: str) -> str:
    return term.lower().strip()


class Lexicon:
    """A small dictionary on the driver: it is folded into plans as literals or as an edge table."""

    def __init__(self, groups: Iterable[Iterable[str]] | None = None) -> None:
        self.groups: list[list[str]] = []
        self.synonyms: dict[str, set[str]] = {}
        given = ([t.strip() for t in line.split(",")] for line in DEFAULT_GROUPS.strip().splitlines()) if groups is None else groups
        for group in given:
            self.add_group(group)

    def add_group(self, terms: Iterable[str]) -> None:
        """All terms of a group become synonyms of each other; blank ones are left out."""
        group = sorted({_normal(t) for t in terms} - {""})
        self.groups.append(group)
        for term in group:
            self.synonyms.setdefault(term, set()).update(t for t in group if t != term)

    def get(self, term: str) -> set[str]:
        """The term, normalised, and its synonyms."""
        key = _normal(term)
        return {key} | self.synonyms.get(key, set())

    def expand(self, query: str) -> str:
        """Each word with synonyms becomes '(a OR b ...)', in alphabetical order."""
        return " ".join(f"({' OR '.join(sorted(found))})" if len(found := self.get(w)) > 1 else w for w in query.lower().split())

    def find(self, text: str) -> dict[str, list[str]]:
        """Terms that occur anywhere in a text, inside words too, with their synonyms."""
        low = text.lower()
        return {t: sorted(s) for t, s in sorted(self.synonyms.items()) if t in low}

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({t: sorted(s) for t, s in sorted(self.synonyms.items())}, f, ensure_ascii=False, indent=2)

    def load(self, path: str) -> bool:
        """Replaces everything by a saved dictionary; without a readable file everything stays."""
        try:
            with open(path, encoding="utf-8") as f:
                read = {_normal(t): {_normal(s) for s in found} for t, found in json.load(f).items()}
        except (OSError, ValueError, AttributeError, TypeError):
            return False
        self.synonyms = read
        self.groups = [sorted({t, *found}) for t, found in read.items()]
        return True

    # --- in plans ---------------------------------------------------------------------------------------------------

    def edges(self, spark: SparkSession) -> DataFrame:
        """(term, synonym), by a self-join of the groups' members."""
        rows = [(k, t) for k, g in enumerate(self.groups) for t in g]
        return group_edges(spark.createDataFrame(rows, "group_id int, term string"))

    def as_map(self) -> Column:
        """A literal map from term to its sorted synonyms."""
        entries = [x for t, s in sorted(self.synonyms.items()) for x in (F.lit(t), F.array(*[F.lit(v) for v in sorted(s)]) if s else F.array().cast("array<string>"))]
        return F.create_map(*entries) if entries else F.create_map().cast("map<string,array<string>>")

    def synonyms_of(self, c: Column | str) -> Column:
        """The sorted array of a term and its synonyms."""
        key = normalize_term(c)
        return F.array_sort(F.array_distinct(F.concat(F.array(key), F.coalesce(F.try_element_at(self.as_map(), key), F.array().cast("array<string>")))))

    def expand_column(self, c: Column | str) -> Column:
        table = self.as_map()

        def word(w: Column) -> Column:
            found = F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))
            return F.when(F.size(found) > 0, F.concat(F.lit("("), F.array_join(F.array_sort(F.array_union(F.array(w), found)), " OR "), F.lit(")"))).otherwise(w)

        return F.array_join(F.transform(query_words(c), word), " ")

    def terms_in(self, c: Column | str) -> Column:
        """The sorted array of terms that occur anywhere in the text."""
        low = F.lower(F.col(c) if isinstance(c, str) else c)
        return F.filter(F.array(*[F.lit(t) for t in sorted(self.synonyms)]), lambda t: F.coalesce(F.contains(low, t), F.lit(False)))


def group_edges(members: DataFrame) -> DataFrame:
    """(term, synonym) from (group_id, term): all ordered pairs of different terms of a group, each once."""
    terms = members.select("group_id", normalize_term("term").alias("term")).where("term <> ''").distinct()
    others = terms.select("group_id", F.col("term").alias("synonym"))
    return terms.join(others, "group_id").where("term <> synonym").select("term", "synonym").distinct()
