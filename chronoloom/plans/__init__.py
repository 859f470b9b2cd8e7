"""Views over the tables and the registered queries, by family. Any of the modules may be imported first."""

from chronoloom import registry  # noqa: F401
