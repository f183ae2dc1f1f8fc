from freshet.cli import main

main()
