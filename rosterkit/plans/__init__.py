"""Session settings, checkpoint folder and plan checks."""

from .session import build_session, ensure_checkpoint_dir, scale_settings

__all__ = ["build_session", "ensure_checkpoint_dir", "scale_settings"]
