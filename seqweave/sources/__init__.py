from .files import *  # noqa: F403
