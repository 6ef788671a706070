"""Tokeniser profiles: special tokens and the per-mode formatting/tokenising
dispatch (pre_training, alpaca / post_training_sft, openassistant / post_training_rl)."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
BASE_SPECIALS = ["[UNK]", "[PAD]", "[SOS]", "[EOS]"]
CHAT_SPECIALS = ["<SYSTEM>", "</SYSTEM>", "<USER>", "</USER>", "<MODEL>", "</MODEL>"]
IGNORE_INDEX = -100
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    name: str
    specials: list[str] = field(default_factory=list)
    pad: str = "[PAD]"
    stop: str = "[EOS]"
    modes: tuple[str, ...] = ("pre_training",)

    @property
    def unk(self) -> str:
        return "[UNK]"

    def check_mode(self, mode: str) -> str:
        if mode not in self.modes:
            raise ValueError(f"profile {self.name} has no mode {mode!r} (it has {', '.join(self.modes)})")
        return mode


PRE_TRAINING_V1 = Profile("pre_training_v1", list(BASE_SPECIALS))
POST_TRAINING_V1 = Profile("post_training_v1", BASE_SPECIALS + CHAT_SPECIALS, stop="</MODEL>",
                           modes=("pre_training", "post_training_sft", "post_training_rl"))
SENTENCE_PIECE_V2 = Profile("sentence_piece_v2", BASE_SPECIALS + CHAT_SPECIALS, stop="</MODEL>")

PROFILES = {p.name: p for p in (PRE_TRAINING_V1, POST_TRAINING_V1, SENTENCE_PIECE_V2)}


def get_profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"Unknown profile: {name}")
    return PROFILES[name]
