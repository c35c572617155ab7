"""Operators a training-data pipeline needs beyond the table lifecycle.  Nothing else imports this subpackage."""
