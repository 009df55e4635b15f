

from . import merge as merge  # before its parts, which import names from it
