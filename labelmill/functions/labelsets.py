"""Label vocabularies and the small dimension table built from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.session import small_table

# Label vectors are laid out in exactly these orders.
FINE_LABELS = [
    "homophobia", "transphobia", "classism", "sexism", "racism", "religious-discrimination",
    "ableism", "body-shaming", "other-discrimination",
    "violence", "kidnapping", "death", "collective-violence", "other-aggression",
    "abuse", "sexual-abuse", "child-abuse", "animal-abuse", "abusive-language", "other-abuse",
    "miscarriage", "abortion", "childbirth", "other-pregnancy",
    "blood-gore", "procedures", "other-medical",
    "dysmorphia", "self-harm", "suicide", "mental-illness", "addiction", "other-mental-health",
    "pornography", "incest", "other-sexual",
]

# The fine labels that stay open to further meanings; the rest are closed.
OPEN_FINE_LABELS = [
    "other-discrimination", "other-aggression", "other-abuse", "other-pregnancy",
    "other-medical", "other-mental-health", "other-sexual",
]

# Coarse label order and the fine labels each one covers.
COARSE_LABELS = [
    "discrimination", "aggression", "abuse", "pregnancy", "medical", "mental-health",
    "sexual-content",
]
COARSE_MEMBERS = {
    "discrimination": ["homophobia", "transphobia", "classism", "sexism", "racism",
                       "religious-discrimination", "ableism", "body-shaming",
                       "other-discrimination"],
    "aggression": ["violence", "kidnapping", "death", "collective-violence", "other-aggression"],
    "abuse": ["abuse", "sexual-abuse", "child-abuse", "animal-abuse", "abusive-language",
              "other-abuse"],
    "pregnancy": ["miscarriage", "abortion", "childbirth", "other-pregnancy"],
    "medical": ["blood-gore", "procedures", "other-medical"],
    "mental-health": ["dysmorphia", "self-harm", "suicide", "mental-illness", "addiction",
                      "other-mental-health"],
    "sexual-content": ["pornography", "incest", "other-sexual"],
}

# Labels from the most to the least frequent one in the published corpus.
FINE_BY_FREQUENCY = [
    "pornography", "violence", "other-mental-health", "death", "other-sexual", "sexual-abuse",
    "abuse", "other-medical", "blood-gore", "abusive-language", "suicide", "child-abuse",
    "childbirth", "mental-illness", "addiction", "incest", "homophobia", "self-harm",
    "kidnapping", "other-aggression", "collective-violence", "procedures", "dysmorphia",
    "other-pregnancy", "other-abuse", "sexism", "other-discrimination", "racism", "miscarriage",
    "animal-abuse", "transphobia", "abortion", "ableism", "religious-discrimination", "classism",
    "body-shaming",
]
COARSE_BY_FREQUENCY = [
    "sexual-content", "aggression", "abuse", "mental-health", "medical", "pregnancy",
    "discrimination",
]

SECTIONS = ("top", "mid", "bot")


@dataclass(frozen=True)
class LabelSet:
    """An ordered label vocabulary with its roll-up, openness and frequency order."""

    labels: list[str]
    coarse_of: dict[str, str] = field(default_factory=dict)
    open_labels: frozenset[str] = frozenset()
    by_frequency: list[str] = field(default_factory=list)

    @property
    def closed_labels(self) -> list[str]:
        return [name for name in self.labels if name not in self.open_labels]

    def section_of(self, label: str) -> str | None:
        """Frequency third of a label: top, mid or bot; earlier thirds take the remainder."""
        if label not in self.by_frequency:
            return None
        size, longer = divmod(len(self.by_frequency), len(SECTIONS))
        rank = self.by_frequency.index(label)
        for number, section in enumerate(SECTIONS):
            rank -= size + (number < longer)
            if rank < 0:
                return section
        return None

    def positions(self, names) -> list[int]:
        wanted = set(names)
        return [i for i, name in enumerate(self.labels) if name in wanted]

    def literal(self) -> Column:
        """The labels as a constant array column."""
        return F.array(*[F.lit(name) for name in self.labels])

    def dim(self, spark: SparkSession) -> DataFrame:
        """One row per label. Its size is the vocabulary, never the data, so it may be broadcast."""
        rows = [
            (name, i, self.coarse_of.get(name), name not in self.open_labels, self.section_of(name),
             self.by_frequency.index(name) + 1 if name in self.by_frequency else None)
            for i, name in enumerate(self.labels)
        ]
        return small_table(
            spark, rows,
            "label string, idx int, coarse string, is_closed boolean, section string, freq_rank int")


FINE = LabelSet(
    FINE_LABELS,
    {fine: coarse for coarse, members in COARSE_MEMBERS.items() for fine in members},
    frozenset(OPEN_FINE_LABELS),
    FINE_BY_FREQUENCY,
)
COARSE = LabelSet(COARSE_LABELS, by_frequency=COARSE_BY_FREQUENCY)

# The column of a work that holds each label set's names.
LABEL_COLUMNS = {"warnings_fine_open": FINE, "warnings_coarse_open": COARSE}


# The label set of a model's vectors, by the level that its name states.
LEVELS = {"coarse": COARSE, "fine": FINE}


def level_of(model: Column) -> Column:
    """Level of a model: `coarse` where its name says so, else `fine`."""
    return F.when(model.contains("coarse"), "coarse").otherwise("fine")


def label_set(name: str) -> LabelSet:
    """Label set for a works column; unknown names are refused instead of read as coarse."""
    if name not in LABEL_COLUMNS:
        raise ValueError(f"unknown label set {name!r}; use one of {sorted(LABEL_COLUMNS)}")
    return LABEL_COLUMNS[name]
