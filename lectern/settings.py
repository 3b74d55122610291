"""Settings of the analysis rules and the labels that results carry."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

# Labels of results.
MUSIC = "музыка"
SILENCE = "тишина"
QUIET_SOUNDS = "тихие звуки"
OTHER = "шум/другое"
NO_SPEECH = "нет речи"
MUSIC_UNDER = "музыка под речью"
QUIET_SPEECH = "тихая речь"
LEFTOVER = "короткий кусок между вырезами"
BACKGROUND_MUSIC = "фоновая музыка под речью"
PHRASE = "фраза со словом"
NOT_CONVERSATION = "НЕ РАЗГОВОР"
NOT_MEDICAL = "НЕ МЕДИЦИНСКАЯ ТЕМА"
NOT_BRITISH = "НЕ БРИТАНСКИЙ АКЦЕНТ"
MUSIC_NOTE = "МУЗЫКА ПОД РЕЧЬЮ"
REPEAT_NOTE = "ПОВТОР строки "
BRITISH = "британский"


@dataclass(frozen=True)
class Settings:
    """Defaults of the rules; times in seconds, levels in dB, music as probabilities."""

    max_gap: float = 7.0
    edge_min: float = 3.0
    music_min: float = 2.0
    music_thr: float = 0.30
    bg_music: bool = True
    bg_music_thr: float = 0.10
    bg_window: int = 9
    bg_min_run: int = 10
    min_keep: float = 8.0
    quiet_enabled: bool = True
    quiet_abs: float = -31.0
    quiet_rel: float = -7.0
    quiet_win: float = 60.0
    quiet_min: float = 20.0
    blip_max: float = 1.5
    blip_isolation: float = 4.0
    event_db: float = 12.0
    prominent_db: float = 10.0
    other_min: float = 0.0
    short_gap: float = 5.0
    merge_gap: float = 1.0
    words: str = "YouTube, subscribe, video, channel, actor, exam"
    words_phrase: bool = True
    accent: bool = True
    topic: bool = True
    dialogue: bool = True
    only_suitable: bool = True
    threads: int = 0
    unfit_music_share: float = 0.5
    phrase_pause: float = 0.8
    clause_pause: float = 0.4
    phrase_max: float = 20.0
    speaker_win: float = 1.5
    separation: float = 0.15
    minor_share: float = 0.15
    turns_per_min: float = 1.8
    encounter_min: float = 1.0

    def fingerprint(self) -> str:
        """Names a state of the settings; stored results of another one are computed again."""
        return hashlib.sha1(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    @classmethod
    def from_saved(cls, saved: dict) -> Settings:
        """Settings from a stored record; keys that are no longer known are dropped."""
        return cls(**{k: v for k, v in saved.items() if k in cls.__dataclass_fields__})


DEFAULTS = Settings()
