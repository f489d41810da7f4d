"""Token ids, delays and limits of the multi-stream format; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TokenConfig:
    """Ids, delays and frame rate of the stream format. ``delays`` has one entry per row of the merged 17-row matrix."""

    text_pad: int = 3
    text_epad: int = 0
    main_bos: int = 1
    other_bos: int = 2
    text_initial: int = 32_000
    audio_initial: int = 2_048
    zero: int = -1
    codebooks: int = 8
    delays: tuple[int, ...] = field(default=(0, 0, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 1))
    frame_rate: float = 12.5

    @property
    def initials(self) -> tuple[int, ...]:
        """The id before a row's first frame: text for row 0, audio for the others."""
        return (self.text_initial, *[self.audio_initial] * (len(self.delays) - 1))

    @property
    def pads(self) -> tuple[int, ...]:
        return (self.text_pad, *[self.audio_initial] * (len(self.delays) - 1))
