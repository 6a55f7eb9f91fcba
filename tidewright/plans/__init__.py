"""Run plans: domain, configuration, estimate, simulation and command line."""
