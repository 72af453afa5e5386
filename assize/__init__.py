"""Spark jobs that check model verdicts against declared rules, at corpus scale."""
