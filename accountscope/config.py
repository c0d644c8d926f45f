"""Typed, validated settings for the four stages."""

from __future__ import annotations

from dataclasses import dataclass, field

# Feature names.
STATIC_FEATURES = (
    "num_tweets",
    "num_followers",
    "num_followings",
    "about_me_length",
    "user_name_length",
    "num_annotations",
    "num_http",
    "tweet_avg_length",
    "num_unique_words",
)
PERIOD_FEATURES = ("average_tweets_ByDay", "average_tweets_ByHour", "average_tweets_ByMonth")
#: Column in which readers put where a row stands in its files, when asked for it.
POSITION = "file_position"
MODELS = ("decision_tree", "random_forest", "adaboosted_dt", "linear_svc")


def score_columns(topics: int) -> tuple[str, ...]:
    """Names of the per-account score columns for ``topics`` topics."""
    return (
        "dt_entropy",
        *(f"goss_{k}" for k in range(topics)),
        *(f"loss_{k}" for k in range(topics)),
    )


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class PreprocessConfig:
    random_sub_sample: bool = False
    sample_size: int = 1000
    seed: int = 42
    null_text: str | None = None
    max_part_rows: int = 100_000
    #: Column of the static table whose smallest value marks the first of several rows of an account. None takes
    #: ``POSITION``, the order of the files, where the table has it, and else the row with the smallest values.
    first_by: str | None = None
    #: Add posts per active day, hour and month to the static features.
    period_features: bool = False

    def __post_init__(self) -> None:
        _require(self.sample_size > 0, "sample_size must be positive")
        _require(self.max_part_rows > 0, "max_part_rows must be positive")


@dataclass(frozen=True)
class FeatureConfig:
    ngram_range: tuple[int, int] = (1, 2)
    min_df: float = 0.15
    max_df: float = 0.85
    topics: int = 5
    passes: int = 5
    learning_offset: float = 10.0
    learning_decay: float = 0.7
    batch_size: int = 128
    seed: int = 0

    def __post_init__(self) -> None:
        low, high = self.ngram_range
        _require(1 <= low <= high, "ngram_range must satisfy 1 <= low <= high")
        _require(0 <= self.min_df <= self.max_df <= 1, "document shares must satisfy 0 <= min <= max <= 1")
        _require(self.topics > 1 and self.passes > 0, "topics must exceed 1 and passes be positive")


@dataclass(frozen=True)
class ClusterConfig:
    clusters: int = 3
    max_iterations: int = 300
    n_init: int = 10
    tol: float = 1e-4
    seed: int = 42
    features: tuple[str, ...] = ("dt_entropy", "num_unique_words")

    def __post_init__(self) -> None:
        _require(self.clusters > 1, "clusters must exceed 1")
        _require(self.n_init > 0, "n_init must be positive")
        _require(len(self.features) > 0, "no clustering feature is switched on")


@dataclass(frozen=True)
class ClassifyConfig:
    models: tuple[str, ...] = MODELS
    folds: int = 10
    train: float = 0.6
    seed: int = 42
    boosting_rounds: int = 50
    forest_trees: int = 10
    max_depth: int = 30
    #: Candidate thresholds of a feature in all tree models, plus one; exact where it has no more distinct values.
    max_bins: int = 32
    #: Let decision trees try every distinct value instead of ``max_bins``.
    exact_cuts: bool = False
    #: "SAMME.R" boosts class probabilities, "SAMME" class votes.
    boosting: str = "SAMME.R"
    #: Scale columns before fitting margins.
    standardise: bool = True
    #: Feature names for every cluster, or per cluster id; None takes all numeric columns.
    features: tuple[str, ...] | dict[int, tuple[str, ...]] | None = None

    def __post_init__(self) -> None:
        unknown = set(self.models) - set(MODELS)
        _require(not unknown, f"unknown models: {sorted(unknown)}")
        _require(0 < self.train < 1, "train must lie between 0 and 1")
        _require(self.folds > 0, "folds must be positive")
        _require(self.max_bins > 1, "max_bins must exceed 1")
        _require(self.boosting in ("SAMME.R", "SAMME"), "boosting must be SAMME.R or SAMME")

    @property
    def test_share(self) -> float:
        return round(1 - self.train, 12)


@dataclass(frozen=True)
class RunConfig:
    preprocess: PreprocessConfig = field(default_factory=PreprocessConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    cluster: ClusterConfig = field(default_factory=ClusterConfig)
    classify: ClassifyConfig = field(default_factory=ClassifyConfig)
    #: Stages to run, in order.
    stages: tuple[str, ...] = ("preprocess", "features", "cluster", "classify")

    def __post_init__(self) -> None:
        order = ("preprocess", "features", "cluster", "classify")
        _require(set(self.stages) <= set(order), f"stages must be taken from {order}")
