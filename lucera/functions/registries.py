"""Named extension points: measures between streams, bias corrections, distances, geometries, pipeline steps
and the callables that fits and simulators take by name."""

from __future__ import annotations

import difflib
from collections.abc import Callable


class Registry:
    """Functions by name; asking for an unknown one tells the nearest names."""

    def __init__(self, what: str):
        self.what, self.items = what, {}

    def register(self, name, **attributes):
        def put(f: Callable) -> Callable:
            self.items[name] = (f, attributes)
            return f

        return put

    def get(self, name) -> Callable:
        return self._found(name)[0]

    def attributes(self, name) -> dict:
        return self._found(name)[1]

    def _found(self, name):
        if name not in self.items:
            near = difflib.get_close_matches(str(name), [str(k) for k in self.items], 3, 0.5)
            raise KeyError(f"unknown {self.what} {name!r}" + (f"; did you mean {', '.join(near)}?" if near else f"; known: {', '.join(map(str, self.items))}"))
        return self.items[name]

    def resolve(self, given) -> Callable:
        """A callable as it is, or the one of that name."""
        return given if callable(given) else self.get(given)


#: f(x, y, fs, **options) -> number, for the channels of one stream with those of another.
CROSS_MEASURES = Registry("cross measure")
#: f(x, y, measure, surrogates, seed) -> number; keyed by (correction, measure).
BIAS_CORRECTIONS = Registry("bias correction")
#: f(matrix, matrix) -> number.
DISTANCES = Registry("distance of connectivity")
#: f(rho, mua, musp, n, **options) -> fluence, by (geometry, modality).
GEOMETRIES = Registry("geometry")
#: f(g1, **params) -> what is observed; f(tau) -> instrument response; f(data, model) -> residual.
OBSERVATIONS, RESPONSES, RESIDUALS = Registry("observation"), Registry("instrument response"), Registry("residual transform")
#: f(samples, **options) -> samples.
STEPS = Registry("pipeline step")

register_cross_measure, register_distance = CROSS_MEASURES.register, DISTANCES.register
register_step, register_observation, register_response, register_residual = STEPS.register, OBSERVATIONS.register, RESPONSES.register, RESIDUALS.register


def batched(many):
    """Marks a measure of two series with its form for many (functions.pairs), which gives the same values."""

    def mark(f):
        f.many = many
        return f

    return mark


def register_bias_correction(name: str, measure: str, needs_band: bool = False, required: tuple[str, ...] = ()):
    """A correction of one measure; required names of options are checked before it runs."""
    return BIAS_CORRECTIONS.register((name, measure), needs_band=needs_band, required=required)


def bias_correction(name: str, measure: str, **options) -> Callable:
    f, a = BIAS_CORRECTIONS.get((name, measure)), BIAS_CORRECTIONS.attributes((name, measure))
    missing = [k for k in (*a["required"], *(("low", "high") if a["needs_band"] else ())) if k not in options]
    if missing:
        raise ValueError(f"{name} of {measure} needs {', '.join(missing)}")
    return f


def register_geometry(name: str, modality: str):
    return GEOMETRIES.register((name, modality))


def resolve_geometry(given, modality: str) -> Callable:
    return given if callable(given) else GEOMETRIES.get((given, modality))


def _defaults() -> None:
    import numpy as np

    from lucera.functions import diffusion, fitting, layers, pairs, signal, spectra

    register_cross_measure("pearson")(batched(pairs.pearson)(lambda x, y, fs: float(np.corrcoef(x, y)[0, 1])))
    register_cross_measure("coherence")(batched(pairs.coherence)(lambda x, y, fs, low=0.0, high=np.inf, nperseg=64: _band(signal.coherence(x, y, fs, nperseg), low, high)))
    register_cross_measure("wavelet_coherence")(batched(pairs.wavelet_coherence)(lambda x, y, fs, low=0.0, high=np.inf, **kw: _band(spectra.wavelet_coherence(x, y, fs, **kw), low, high)))
    for measure in ("pearson", "coherence", "wavelet_coherence"):
        register_bias_correction("phase_randomization", measure, needs_band=measure != "pearson")(spectra.bias_corrected)
    register_distance("geodesic")(spectra.geodesic_distance)
    register_distance("frobenius")(lambda a, b: float(np.linalg.norm(a - b)))
    register_geometry("semi_infinite", "fd")(diffusion.fd_fluence)
    register_geometry("semi_infinite", "td")(lambda rho, mua, musp, n, t, **kw: diffusion.td_fluence(t, rho, mua, musp, n, **kw))
    register_geometry("semi_infinite", "dcs")(lambda rho, mua, musp, n, tau, wavelength_nm=785.0, **kw: diffusion.dcs_g1(rho, mua, musp, n, wavelength_nm, tau, **kw))
    register_geometry("layered", "fd")(lambda rho, mua, musp, n, thickness, freq=1.1e8: np.array([layers.layered_fd(r, mua, musp, thickness, n, freq)[0] for r in np.atleast_1d(rho)]))
    register_observation("identity")(lambda g1: g1)
    register_observation("siegert")(diffusion.siegert)
    register_response("none")(None)
    register_response("emg")(layers.emg_response)
    register_residual("log_ratio")(fitting.log_ratios)
    register_residual("difference")(lambda data, model: np.asarray(data) - model)


def _band(fc, low, high):
    import numpy as np

    f, c = fc
    c = c[(f >= low) & (f <= high)]
    return float(np.nanmean(c)) if np.isfinite(c).any() else float("nan")


_defaults()
