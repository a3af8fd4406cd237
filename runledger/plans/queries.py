"""Imports every query module so their @register calls run."""

from runledger.plans import q_lifecycle  # noqa: F401
from runledger.plans import q_listing  # noqa: F401
from runledger.plans import q_reconcile  # noqa: F401
from runledger.plans import q_aggregate  # noqa: F401
from runledger.plans import q_runs  # noqa: F401
from runledger.plans import q_audit  # noqa: F401
from runledger.plans import q_stream  # noqa: F401
