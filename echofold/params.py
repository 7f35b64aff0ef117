"""Physical constants and option defaults, passed explicitly to the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
C_LIGHT = 299792458.0          # m/s
RHO_ICE = 917.0                # kg/m^3
EPS_ICE = 3.15                 # relative permittivity of solid ice
KOVACS_A = 0.845               # n = 1 + a * rho, rho in g/cm^3
SEC_PER_YEAR = 365.25 * 86400.0
RHO_SEA = 1028.0               # kg/m^3
GRAVITY = 9.81                 # m/s^2
MAD_SCALE = 1.4826             # MAD of a normal distribution to its sigma
NOISE_FLOOR = 1e-12            # a spread below this share of the values is rounding
UNIX_DATENUM = 719529.0        # day number of 1970-01-01


@dataclass(frozen=True)
class FirnParams:
    """Density column: logistic in depth, from surface to close-off density."""

    rho_sfc: float = 0.35
    rho_bco: float = 0.81
    bco_depth: float = 60.0
    mixing: str = "kovacs"
    max_depth: float = 1500.0
    nz: int = 6001

    def __post_init__(self):
        if self.mixing not in ("kovacs", "looyenga"):
            raise ValueError(f"unknown mixing law {self.mixing!r}")


@dataclass(frozen=True)
class PairOptions:
    """Options of the pair chain (multilook, unwrap, block, fit)."""

    window: tuple[int, int] = (5, 15)      # bins x columns
    coherence_threshold: float = 0.3
    max_gap_bins: int = 20
    phase_sign: int = -1
    ref_offset_s: float = 0.0
    block_size: int = 200
    min_coverage: float = 0.3
    cols_per_look: int = 15
    bins_per_look: int = 5
    fit_order: int = 2
    fit_top: float = 20.0
    fit_bottom: float | None = None
    min_samples: int = 10
    min_fit_range: float = 100.0
    max_baseline: float = 10.0
    coalign_half_win: int = 60
    coalign_max_lag: float = 3.0
    coalign_upsample: int = 32
    coalign_min_quality: float = 0.85
    coalign_win_cols: int = 200


# Rows one task should handle before a group is split into tiles.
ROWS_PER_TILE = 500_000
