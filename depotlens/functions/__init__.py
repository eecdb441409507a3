"""Column expressions; none of them leaves the JVM."""

from .columns import *  # noqa: F401,F403
from .mailfilter import mail_filter  # noqa: F401
