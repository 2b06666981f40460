"""Two-channel intensity arrays clustered at cohort scale, as DataFrame operators."""
