"""DataFrame-to-DataFrame operators: panels, returns, tail risk, controls, stress, explain, studies."""
