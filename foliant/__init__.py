"""Document-set analytics on Spark: search, review productions and text checks.

Every operator is a function from DataFrames to a DataFrame; nothing runs until
the caller triggers an action, except where a docstring says so.
"""

from foliant.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
