"""Settings that change results, as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import fixed_values as V


@dataclass(frozen=True)
class Settings:
    form_type_labels: dict = field(default_factory=lambda: {"F10": "F10", "F174": "F174"})
    pos_label: str = "Pos"
    neg_label: str = "Neg"
    month_format: str = "name"
    f174_commander_role: str = "aoc_signed"
    position_tolerance_pt: int = 10
    parser_version: int = 20
    first_shirt_fill_date: bool = True

    def step_slots(self, form_type: str) -> dict[str, list[str]]:
        """Slots that mark each step done for a form type; one mapping is a setting."""
        slots = {k: list(v) for k, v in V.STEP_SLOTS.get(form_type, {}).items()}
        if form_type == "F174" and self.f174_commander_role in slots:
            slots[self.f174_commander_role] = [V.F174_COMMANDER_SLOT]
        return slots


@dataclass(frozen=True)
class SettlementLayout:
    header_row: int = 9
    headings: dict = field(default_factory=lambda: dict(V.SETTLEMENT_HEADINGS))
    tour_word: str = V.TOUR_WORD
    confinement_word: str = V.CONFINEMENT_WORD
    search_rows: int = 60
