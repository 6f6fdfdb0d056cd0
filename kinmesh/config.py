"""Settings of a linkage run; every default equals the setting that published results rest on."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from dataclasses import dataclass

PREPROCESS_VERSION = 2
#: Where stages are kept, unless a run says otherwise.
CHECKPOINT_ENV = "KINMESH_CHECKPOINT_DIR"


@dataclass(frozen=True)
class Config:
    # Blocking
    char_top_k: int = 30
    char_max_features: int = 200_000
    word_top_k: int = 30
    word_max_features: int = 100_000
    name_top_k: int = 0
    name_max_features: int = 200_000
    max_df: float = 0.05
    use_char: bool = True
    use_word: bool = True
    use_keys: bool = False
    use_dense: bool = True
    use_lsh: bool = False
    key_bucket: int = 100
    dense_top_k: int = 50
    dense_exact: bool = False
    lsh_permutations: int = 128
    lsh_threshold: float = 0.3
    lsh_ngram: int = 3
    lsh_cap: int = 100
    transliterate: bool = True
    # Pre-filter
    prefilter_cap: int = 100
    prefilter_min_score: float = 0.15
    # Training
    seed: int = 42
    val_fraction: float = 0.1
    val_least: int = 10
    neg_pos_ratio: int | None = None
    n_models: int = 3
    hard_floor: float = 0.3
    hard_mix: float = 0.6
    hard_ratio: int = 5
    pool_extra: int | str | None = "full"
    # Decision
    one_to_one: bool = True
    score_floor: float = 0.01
    singleton_best: float = 0.4

    def key(self, kind: str, **args: object) -> str:
        """Twelve hex digits that change with the kind of run, its arguments and every setting."""
        text = json.dumps([kind, args, dataclasses.asdict(self), PREPROCESS_VERSION], sort_keys=True, default=str)
        return hashlib.sha1(text.encode()).hexdigest()[:12]

    def check_floor(self, threshold: float) -> None:
        """Scores under the floor are not stored, so it must not exceed what decisions look at."""
        if self.score_floor > min(threshold, self.singleton_best):
            raise ValueError(f"score_floor {self.score_floor} is above the decision threshold or singleton_best")


def checkpoint_root(default: str = "checkpoints") -> str:
    return os.environ.get(CHECKPOINT_ENV, default)


def pool_extra(sample_size: int | None, full_sample: bool, setting: int | str | None = "full") -> int | None:
    """Random pool records a country besides the must-haves: None is all; a number is itself; unset depends on the sample."""
    if setting == "full":
        return None
    if isinstance(setting, int):
        return setting
    return 500_000 if full_sample or sample_size is None else min(max(3 * sample_size, 20_000), 30_000)
