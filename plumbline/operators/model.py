"""The scoring artifact of a latent-variable model."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Model:
    """Scaler, the model's own centring and scaling, rotations and loadings (J x A), score variances and limits."""

    x_mean: tuple[float, ...]
    x_scale: tuple[float, ...]
    pls_mean: tuple[float, ...]
    pls_std: tuple[float, ...]
    rotations: tuple[tuple[float, ...], ...]
    loadings: tuple[tuple[float, ...], ...]
    eigenvalues: tuple[float, ...]
    ucl_t2: float
    ucl_spe: float
    feature_names: tuple[str, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return self.feature_names or tuple(f"feature{i + 1}" for i in range(len(self.x_mean)))

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Model:
        freeze = lambda v: tuple(map(freeze, v)) if isinstance(v, list | tuple) else v
        return cls(**{k: freeze(v) for k, v in d.items()})
