"""``python -m metaladder``."""

from .cli import main

main()
