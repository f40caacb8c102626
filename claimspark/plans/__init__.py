"""Named concepts, and what is built on their results: findings, impact, risk, reports."""
