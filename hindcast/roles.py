"""Which column plays which part; operators know roles, never data-set names."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    key: str = "txn_id"
    time: str = "t"
    amount: str = "amount"
    label: str = "label"
    score: str = "score"


@dataclass(frozen=True)
class EntityFeatures:
    """Historical features wanted for one entity; an empty ``columns`` means the whole stream.

    Windows map a label used in the output name to a length in units of the time column. ``sums`` adds
    the total of each amount window.
    """

    name: str
    columns: tuple[str, ...] = ()
    velocity: dict[str, int] = field(default_factory=dict)
    amounts: dict[str, int] = field(default_factory=dict)
    recency: bool = False
    history: bool = False
    sums: bool = False

    def outputs(self) -> list[str]:
        names = [f"velocity_{self.name}_{w}" for w in self.velocity]
        for w in self.amounts:
            names += [f"amount_{self.name}_{w}_{s}" for s in ("mean", "std", "zscore", *(["sum"] if self.sums else []))]
        if self.recency:
            names.append(f"recency_{self.name}")
        if self.history:
            names += [f"history_{self.name}_count", f"is_new_{self.name}"]
        return names
