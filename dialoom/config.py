"""Settings of a training run's data and their checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from dialoom.operators.batch import Augmentation, speaker_spec

MAY_DIFFER = ("output_dir", "max_steps", "resume_from")  # settings in which a resumed run may differ


@dataclass(frozen=True)
class DataConfig:
    """The data side of a run. `train_speakers` has one spec ('A', 'B' or 'A,B') for each training file pattern; without
    it, both speakers of all files are used."""

    train_files: list[str]
    train_speakers: list[str] | None = None
    eval_files: list[str] | None = None
    eval_speakers: str = "A,B"
    eval_steps: int | None = None
    max_length: int | None = None
    min_length: int | None = None
    batch_size: int = 1
    accumulate: int = 1
    use_events: bool = True
    hint_only: bool = False
    warmup_start: int | None = None
    warmup_end: int | None = None
    augmentation: Augmentation = field(default_factory=lambda: Augmentation(shift_prob=1.0, skip=(0.1, 0.7)))
    output_dir: str = ""
    max_steps: int | None = None
    resume_from: str | None = None
    tracked: bool = False

    def __post_init__(self) -> None:
        if not self.train_files:
            raise ValueError("no training files are given")
        if self.train_speakers is not None and len(self.train_speakers) != len(self.train_files):
            raise ValueError(f"{len(self.train_speakers)} speaker specs for {len(self.train_files)} training files")
        for spec in [*(self.train_speakers or []), self.eval_speakers]:
            speaker_spec(spec)
        if self.eval_files is not None and not isinstance(self.eval_steps, int):
            raise ValueError("evaluation files need the steps between evaluations")
        if min(self.batch_size, self.accumulate) < 1:
            raise ValueError("batch size and accumulation must be positive")
        if (self.warmup_start is None) != (self.warmup_end is None):
            raise ValueError("start and end of the warm-up must be given together")
        if self.warmup_start is not None:
            if not self.hint_only:
                raise ValueError("a warm-up needs hint_only")
            if self.warmup_start < 0 or self.warmup_end <= self.warmup_start:
                raise ValueError("the warm-up must start at 0 or later and end after its start")

    def resumed(self, previous: dict) -> str | None:
        """Checks a resumed run against the settings it was begun with; gives the tracker's run id, None if there was none."""
        own = asdict(self)
        other = [k for k, v in own.items() if k not in MAY_DIFFER and previous.get(k) != v]
        if other:
            raise ValueError(f"settings differ from the run that is resumed: {', '.join(f'{k}: {previous.get(k)} != {own[k]}' for k in other)}")
        return previous.get("run_id")
