from .apply import apply_fitted, micro_batched_files
from .resample import DayStates, resample_stream

__all__ = ["DayStates", "apply_fitted", "micro_batched_files", "resample_stream"]
