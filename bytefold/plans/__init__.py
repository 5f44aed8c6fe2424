"""Multi-operator plans: reduction funnel, sweeps, library analysis and pattern export."""
